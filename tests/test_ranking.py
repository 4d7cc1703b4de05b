import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import context, dedup, fusion, ranking
from tessera.plans import queries as queries_of_texts
from tests.conftest import DATA


def chunks(spark, rows):
    return spark.createDataFrame([(i, i, t, v) for i, (t, v) in enumerate(rows)], "chunk_id long, pos long, content string, embedding array<double>")


def queries(spark, *rows):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(rows)], "query_id long, query string, embedding array<double>")


def test_bm25(spark):
    c = chunks(spark, [("the cat sat", [1.0]), ("the dog the dog", [1.0]), ("a bird", [1.0]), ("", [1.0])])
    got = {r.chunk_id: r.bm25_score for r in ranking.bm25(queries(spark, ("Cat the", [1.0])), c).collect()}
    n, avgdl = 4, 9 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, size: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avgdl))
    assert got == pytest.approx({0: idf(2) * part(1, 3) + idf(1) * part(1, 3), 1: idf(2) * part(2, 4)})


def test_ranks_keep_input_order_on_ties_and_fuse(spark):
    rows = spark.createDataFrame([(0, p, b, v) for p, b, v in ((0, 1.0, 0.2), (1, 1.0, 0.9), (2, 0.0, 0.9))], "query_id long, pos long, bm25_score double, vector_score double")
    got = {r.pos: (r.bm25_rank, r.vector_rank, r.hybrid_score) for r in ranking.rrf(rows).collect()}
    assert {k: v[:2] for k, v in got.items()} == {0: (0, 2), 1: (1, 0), 2: (2, 1)}
    assert got[1][2] == pytest.approx(1 / 62 + 1 / 61)
    w = {r.pos: r.hybrid_score for r in ranking.weighted(rows).collect()}
    assert w == pytest.approx({0: 0.4 + 0.6 * 0.2 / 0.9, 1: 1.0, 2: 0.6})
    zero = rows.withColumn("bm25_score", F.lit(0.0)).withColumn("vector_score", F.lit(-1.0))
    assert {r.hybrid_score for r in ranking.weighted(zero).collect()} == {-0.6}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_lists_are_ranked_by_ranges(spark):
    chance = random.Random(7)
    scores = [None, float("nan"), -0.0, 0.0, 0.5, 0.5, 1.0]
    rows = [(chance.choice([None, 1, 2, 3]), n, chance.choice(scores), chance.choice(scores)) for n in range(500)] + [(9, n, 0.0, 1.0) for n in range(700)]
    rows = spark.createDataFrame(rows, "query_id long, pos long, bm25_score double, vector_score double").repartition(5)
    got = ranking.rrf(rows)
    want = ranking.ranked(ranking.ranked(rows, "bm25_score", "bm25_rank"), "vector_score", "vector_rank")
    key = lambda df: sorted((repr(r.query_id), r.pos, r.bm25_rank, r.vector_rank) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 1200
    assert "Window" not in _plan(got)  # no list is one task's


def test_texts_are_read_and_embedded_before_pairs(spark):
    q, c = queries_of_texts._asked(spark, DATA)
    for made in (ranking.bm25(q, c), queries_of_texts._scores(q, c)):
        plan = _plan(made)
        assert "split(" not in plan.replace("split(lower(query", "") and "content" not in plan and "length(text" not in plan


def test_bm25_counts_every_row_and_word(spark):
    c = chunks(spark, [("the the cat", [1.0]), ("the", [1.0]), (None, [1.0]), ("   ", [1.0]), (" dog \t ", [1.0])])
    got = {r.chunk_id: r.bm25_score for r in ranking.bm25(queries(spark, ("the", [1.0]), ("none such", [1.0])), c).collect()}
    idf, avgdl = math.log(1 + (5 - 2 + 0.5) / 2.5), 5 / 5
    assert got == pytest.approx({0: idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 1: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avgdl))})
    assert ranking.bm25(queries(spark, ("the", [1.0])), c.limit(0)).count() == 0


def test_hybrid_and_rerank(spark):
    c = chunks(spark, [("red fox", [1.0, 0.0]), ("blue fox", [0.0, 1.0]), ("green hen", [0.7, 0.7])])
    q = queries(spark, ("fox", [0.0, 1.0]))
    top = fusion.hybrid(q, c, 2)
    assert [r.chunk_id for r in top.orderBy("rank").collect()] == [1, 2] or [r.chunk_id for r in top.orderBy("rank").collect()] == [1, 0]
    best = ranking.rerank(q, c.withColumn("query_id", F.lit(0).cast("long")), 2).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in best] == [1, 2]
    by = ranking.rerank_by(q, c.withColumn("query_id", F.lit(0).cast("long")), lambda query, text: F.length(text).cast("double"), 1).first()
    assert by.chunk_id == 2


def test_candidates_and_text_join(spark):
    b = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], "query_id long, chunk_id long, bm25_rank int")
    v = spark.createDataFrame([(0, 2, 0), (0, 3, 1)], "query_id long, chunk_id long, vector_rank int")
    got = {r.chunk_id: r.hybrid_score for r in ranking.fused_candidates(b, v).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})
    hits = spark.createDataFrame([("a",), ("z",)], "content string")
    index = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "content string, index_pos int")
    assert [(r.content, r.index_pos) for r in ranking.by_text(hits, index).collect()] == [("a", 5)]


def greedy(vectors, scores, t):
    kept = [True] * len(vectors)
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    for i in range(len(vectors)):
        if not kept[i]:
            continue
        for j in range(i + 1, len(vectors)):
            if kept[j] and cos(vectors[i], vectors[j]) > t:
                if scores[j] > scores[i]:
                    kept[i] = False
                    break
                kept[j] = False
    return kept


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, s = rng.normal(size=(15, 3)), rng.integers(0, 4, 15).astype(float)
        assert dedup.greedy_survivors(v, s, 0.6).tolist() == greedy(v, s, 0.6)
    rows = [(0, i, [1.0, 0.0], s) for i, s in enumerate((0.9, 0.7, 0.5, 0.3, 0.2, 0.1))]
    hits = spark.createDataFrame(rows, "query_id long, pos long, embedding array<double>, sort_score double")
    assert [r.pos for r in dedup.drop_near_duplicates(hits, 0.5).collect()] == [0]


def test_first_wins_and_catalogues(spark):
    rows = spark.createDataFrame([("a", "T1", 2), ("a", "T0", 1), (None, "N", 0), ("", "E", 3)], "source string, title string, pos int")
    assert {(r.source, r.n_chunks, r.title, r.first_pos) for r in dedup.catalog(rows).collect()} == {("a", 2, "T0", 1), ("unknown", 1, "N", 0), ("", 1, "E", 3)}
    assert [tuple(r) for r in dedup.sources_in_order(rows).collect()] == [("a", "T0", 1)]
    assert sorted(r.pos for r in dedup.first_wins(rows, ["source"]).collect()) == [0, 1, 3]


def test_compress(spark):
    schema = "query_id long, pos long, source string, title string, content string, vector_score double, hybrid_score double, rerank_score double, embedding array<double>"
    few = [(0, 1, "s1", "t", "second", 0.9, 0.0, 0.0, [1.0]), (0, 0, None, "", "first", 0.1, 0.0, 0.0, [1.0])]
    many = [(1, i, f"http://{i}", "", f"c{i} " + "x" * 300, 0.0, 0.0, i / 10, [math.cos(i), math.sin(i)]) for i in range(10)]
    same = [(2, i, "s", "", "y" * 900, 0.5, 0.0, 0.0, [1.0, 0.0]) for i in range(6)]
    got = {r.query_id: r.context for r in context.compressed(spark.createDataFrame(few + many + same, schema), most=3).collect()}
    assert got[0] == "Source: unknown\nContent: first\nSource: s1\nTitle: t\nContent: second"
    assert got[1].count("Source:") == 3 and "c9" in got[1]
    assert got[2].count("Source:") == 1


def test_budget_and_formats(spark):
    rows = spark.createDataFrame([(0, 0, "a b c"), (0, 1, "d e f g"), (0, 2, "h")], "g long, pos int, text string")
    assert sorted(r.pos for r in context.word_budget(rows, "g", most=5).collect()) == [1, 2]
    assert sorted(r.pos for r in context.word_budget(rows, "g", most=4).collect()) == [2]
    docs = spark.createDataFrame([(0, 0, "s", "t", "c"), (0, 1, None, None, "d")], "query_id long, pos int, source string, title string, content string")
    assert context.formatted(docs).first().context == "Source: s\nTitle: t\nContent: c\n\nSource: None\nTitle: None\nContent: d\n"
    assert context.formatted(docs, top_n=1, family="granite3.3").first().context == '<|start_of_role|>document {"document_id": "s"}<|end_of_role|>\nTitle: t\nc<|end_of_text|>\n'
    one = context.formatted(docs, top_n=1, family="granite3").first().context
    joined = spark.range(1).select(context.joined_contexts(F.lit(one), F.lit(one), "granite3").alias("x")).first()["x"]
    head, tail = "<|start_of_role|>documents<|end_of_role|>\n", "\n<|end_of_text|>"
    assert joined == head + one.removeprefix(head) + "\n\n" + one.removesuffix(tail) + tail


def test_similar_contexts(spark):
    docs = spark.createDataFrame([(i, f"s{i}", "t", f"text {i} " * 400) for i in range(4)], "doc_id long, source string, title string, content string")
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    long = context.context_of(q, docs, embed, most=3).first().context
    assert long.count("Source: ") == 3
    short = context.context_of(q, docs.where("doc_id < 1").withColumn("content", F.lit("tiny")), embed).first().context
    assert short == "Source: s0\nTitle: t\nContent: tiny\n"
    sections = spark.createDataFrame([(0, "A", "x " * 50), (1, "B", "y " * 50)], "doc_id long, section_title string, written_content string")
    assert context.written_for_titles(q, sections, embed).count() == 2
