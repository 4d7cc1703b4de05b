"""Exact fusion against whole rankings: ties, repeated chunks, chunks without a common word."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, ranking
from tessera.sources.tables import numbered


def test_ranks_are_counted_exactly(spark):
    chance = random.Random(2)
    pairs = [(q, o, chance.choice([0.0, 0.5, 0.5, round(chance.random(), 3), -0.25])) for q in range(3) for o in range(400)]
    pairs += [(7, o, 1.0) for o in range(300)]  # all tied
    by_query = {q: sorted((-s, o) for x, o, s in pairs if x == q) for q in (0, 1, 2, 7)}
    chosen = chance.sample(pairs, 60)
    rows = lambda x: spark.createDataFrame(x, "query_id long, ordinal long, score double")
    got = fusion.ranks_of(rows(chosen), rows(pairs)).collect()
    assert Counter((r.query_id, r.ordinal, r["rank"]) for r in got) == Counter((q, o, by_query[q].index((-s, o))) for q, o, s in chosen)


def _case(spark):
    chance = random.Random(4)
    words = "fox lake hill star road moon sun bird".split()
    rows = [(i % 90, f"c{i % 60}", " ".join(chance.choice(words) for _ in range(chance.randint(1, 6))), [float(chance.randint(-2, 2)) for _ in range(3)]) for i in range(240)]
    rows += [(5, "c5", "red fox runs", [1.0, 0.0, 1.0])] * 40  # one chunk, many times
    chunks = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "pos long, chunk_id string, content string, embedding array<double>, number long").repartition(5)
    queries = spark.createDataFrame([(1, "fox moon", [1.0, 0.0, 1.0]), (2, "nothing of this", [0.0, 1.0, 0.0]), (3, "red red bird", [-1.0, 2.0, 0.5])], "query_id long, query string, embedding array<double>")
    return queries, chunks


@pytest.mark.parametrize("mode", ["rrf", "weighted", "vector"])
def test_hybrid_equals_whole_ranking(spark, mode):
    queries, chunks = _case(spark)
    own = numbered(chunks, ["pos", "chunk_id"])
    both = ranking.vector_scores(queries, own, "ordinal").join(ranking.bm25(queries, own, "ordinal"), ["query_id", "ordinal"], "left").fillna(0.0, ["bm25_score"])
    both = both.withColumns({c: F.round(c, fusion.DIGITS) for c in ("vector_score", "bm25_score")})
    if mode == "rrf":
        whole = ranking.rrf(both, pos="ordinal", k=3).withColumn("hybrid_score", F.round("hybrid_score", 12))
    else:
        whole = ranking.weighted(both, *((0.0, 1.0) if mode == "vector" else (0.4, 0.6)))
    want = ranking.ranked(whole, "hybrid_score", "rank", pos="ordinal", most=12).collect()
    found = fusion.hybrid(queries, chunks, 12, mode, k=3).collect()
    key = lambda rows: sorted((r.query_id, r["rank"], round(r.hybrid_score, 9), r.vector_score, r.bm25_score) for r in rows)
    assert key(found) == key(want) and len(found) == 36
    assert {r.content for r in found} <= {r.content for r in chunks.collect()}


def test_repeated_documents_stay_single(spark):
    chunks = spark.createDataFrame([(0, "0-0", "red fox runs", [1.0]), (0, "0-0", "red fox runs", [1.0]), (1, "1-0", "blue lake", [1.0])], "pos long, chunk_id string, content string, embedding array<double>")
    queries = spark.createDataFrame([(0, "fox", [1.0])], "query_id long, query string, embedding array<double>")
    rows = fusion.hybrid(queries, chunks, 9).orderBy("rank").collect()
    assert [(r.content, r["rank"]) for r in rows] == [("red fox runs", 0), ("red fox runs", 1), ("blue lake", 2)]
    assert rows[0].bm25_score == rows[1].bm25_score and abs(rows[0].bm25_score - ranking.bm25(queries, numbered(chunks, ["pos"]), "ordinal").first().bm25_score) < 1e-8
    assert fusion.hybrid(queries, chunks.limit(0), 9).count() == 0
