"""Exact fusion of two ranked lists without ranking all pairs.

Of two lists' fused ranks only the best are wanted. A threshold says how far
each list must be read: a chunk beyond the first ``depth`` of both has less than
the k-th best of either list alone, so it can't enter. What the candidates of
one list have as rank in the other is counted, not sorted: a histogram over all
scores, fine only where candidates lie, is summed task by task, so that pairs of
queries and chunks stream by and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import cosine
from tessera.operators import ranking
from tessera.sources.tables import numbered, written

#: Parameters: bins of the histogram; digits that scores count to, as sums differ in their last digits by order.
BINS, DIGITS = 4096, 9


def ranks_of(candidates: DataFrame, pairs: DataFrame, out: str = "rank") -> DataFrame:
    """``candidates`` (query_id, ordinal, score) with their 0-based rank among ``pairs`` (query_id, ordinal, score), by descending score, then ordinal.

    A candidate's rank is the number of pairs above it: those in higher bins,
    those of its bin with higher scores, and of its very score those with
    smaller ordinals, which have bins of their own. Each level counts exactly
    only where the level above holds a candidate.
    """
    spans = candidates.groupBy("query_id").agg(F.min("score").alias("_low"), F.max("score").alias("_high"), F.max("ordinal").alias("_last"))
    score_bin = F.least(F.lit(BINS), F.floor((F.col("score") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * BINS))
    order_bin = F.floor(F.col("ordinal") * BINS / (F.col("_last") + 1))
    binned = lambda df: df.join(spans, "query_id").withColumn("_bin", F.coalesce(score_bin, F.when(F.col("score") > F.col("_high"), BINS + 1).otherwise(0)))
    mine = written(binned(candidates).withColumn("_at", order_bin).drop("_low", "_high", "_last"), "candidates")
    at_bin = mine.select("query_id", "_bin").distinct().withColumn("_b", F.lit(True))
    at_score = mine.select("query_id", "score").distinct().withColumn("_s", F.lit(True))
    at_place = mine.select("query_id", "score", "_at").distinct().withColumn("_p", F.lit(True))
    rows = binned(pairs).where(F.col("score") >= F.col("_low")).withColumn("_at", order_bin)
    rows = rows.join(at_bin, ["query_id", "_bin"], "left").join(at_score, ["query_id", "score"], "left").join(at_place, ["query_id", "score", "_at"], "left")
    fine = lambda flag, c: F.when(F.col(flag), F.col(c)).alias(c)
    counts = written(rows.groupBy("query_id", "_bin", fine("_b", "score"), fine("_s", "_at"), fine("_p", "ordinal")).agg(F.count("*").alias("_n")), "counts")
    above = Window.partitionBy("query_id").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    bins = counts.select("query_id", "_bin", "_n").unionByName(mine.select("query_id", "_bin", F.lit(0).cast("long").alias("_n")))  # also of candidates that no pair is near
    higher = bins.groupBy("query_id", "_bin").agg(F.sum("_n").alias("_n")).select("query_id", "_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_higher"))
    c, r = mine.alias("c"), counts.where("score is not null").alias("r")
    before = (F.col("r.score") > F.col("c.score")) | ((F.col("r.score") == F.col("c.score")) & ((F.col("r._at") < F.col("c._at")) | ((F.col("r._at") == F.col("c._at")) & (F.col("r.ordinal") < F.col("c.ordinal")))))
    near = c.join(r, (F.col("c.query_id") == F.col("r.query_id")) & (F.col("c._bin") == F.col("r._bin")) & before).groupBy("c.query_id", "c.ordinal").agg(F.sum("r._n").alias("_near"))
    done = mine.join(higher, ["query_id", "_bin"], "left").join(near, ["query_id", "ordinal"], "left")
    return done.select("query_id", "ordinal", "score", (F.coalesce("_higher", F.lit(0)) + F.coalesce("_near", F.lit(0))).alias(out))


def _first(pairs: DataFrame, most: int) -> DataFrame:
    return ranking.ranked(pairs, "score", "_rank", pos="ordinal", most=most).select("query_id", "ordinal")


class Lists:
    """The two lists of stated queries over all chunks, each chunk under a number of its own, so that repeated chunk ids stay apart."""

    def __init__(self, queries: DataFrame, chunks: DataFrame, key: str):
        scores = ("vector_score", "bm25_score", "hybrid_score", "rerank_score")
        self.queries = queries
        self.chunks = numbered(chunks.drop(*scores), ["pos", key])
        rounded = lambda c: F.round(c, DIGITS).alias("score")
        self.vectors = ranking.vector_scores(queries, self.chunks, "ordinal").select("query_id", "ordinal", rounded("vector_score"))
        self.words = written(ranking.bm25(queries, self.chunks, "ordinal").select("query_id", "ordinal", rounded("bm25_score")), "words")

    def scored(self, candidates: DataFrame) -> DataFrame:
        """(query_id, ordinal, vector_score, bm25_score) of ``candidates``."""
        rows = candidates.join(self.chunks.select("ordinal", "embedding"), "ordinal").join(self.queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        rows = rows.select("query_id", "ordinal", F.round(cosine("_q", "embedding"), DIGITS).alias("vector_score"))
        return written(rows.join(self.words.withColumnRenamed("score", "bm25_score"), ["query_id", "ordinal"], "left").fillna(0.0, ["bm25_score"]), "scored")


def top_rrf(lists: Lists, top_k: int, k: int) -> DataFrame:
    """The ``top_k`` of each query by the sum of 1 / (k + rank + 1), exactly as if both lists were ranked whole.

    The top_k-th of one list alone has 1 / (k + top_k) at least; a chunk beyond
    ``depth`` = k + 2 * top_k of both has 2 / (k + depth + 1) at most, which is
    less. Chunks without a common word follow those with one in the list of
    words, by number, and their ranks follow from numbers alone.
    """
    depth = k + 2 * top_k
    many = lists.words.groupBy("query_id").agg(F.count("*").alias("_many"))
    many = written(lists.queries.select("query_id").join(many, "query_id", "left").fillna(0, ["_many"]), "many")
    early = lists.chunks.where(F.col("ordinal") < 2 * depth).select("ordinal").join(many.where(F.col("_many") < depth).select("query_id"))  # at most 2 * depth rows a query
    candidates = _first(lists.vectors, depth).unionByName(_first(lists.words, depth)).unionByName(early.select("query_id", "ordinal")).distinct()
    rows = lists.scored(candidates)
    one = lambda score, where="true": rows.where(where).select("query_id", "ordinal", F.col(score).cast("double").alias("score"))
    vector = ranks_of(one("vector_score"), lists.vectors, "vector_rank").drop("score")
    said = ranks_of(one("bm25_score", "bm25_score > 0"), lists.words, "_said").drop("score")
    by_number = lists.words.select("query_id", "ordinal", (-F.col("ordinal")).cast("double").alias("score"))
    unsaid = ranks_of(rows.where("bm25_score <= 0").select("query_id", "ordinal", (-F.col("ordinal")).cast("double").alias("score")), by_number, "_ahead").drop("score")
    rows = rows.join(vector, ["query_id", "ordinal"]).join(said, ["query_id", "ordinal"], "left").join(unsaid, ["query_id", "ordinal"], "left").join(many, "query_id")
    rows = rows.withColumn("bm25_rank", F.coalesce("_said", F.col("_many") + F.col("ordinal") - F.col("_ahead"))).drop("_said", "_ahead", "_many")
    return ranking.ranked(rows.withColumn("hybrid_score", F.round(ranking.rrf_score("bm25_rank", "vector_rank", k=k), 12)), "hybrid_score", "rank", pos="ordinal", most=top_k)


def top_weighted(lists: Lists, top_k: int, bm25_weight: float, vector_weight: float) -> DataFrame:
    """By scores over their query's largest. A chunk without a common word must be among the ``top_k`` nearest; all others have both scores looked up."""
    near = _first(lists.vectors, top_k)
    rows = lists.scored(near if bm25_weight == 0 else near.unionByName(lists.words.select("query_id", "ordinal")).distinct())
    largest = lambda df, out: df.groupBy("query_id").agg(F.max("score").alias(out))
    rows = rows.join(largest(lists.vectors, "_v"), "query_id").join(largest(lists.words, "_w"), "query_id", "left")
    share = lambda s, m: F.col(s) / F.when(F.col(m) > 0, F.col(m)).otherwise(1.0)
    rows = rows.withColumn("hybrid_score", bm25_weight * share("bm25_score", "_w") + vector_weight * share("vector_score", "_v")).drop("_v", "_w")
    return ranking.ranked(rows, "hybrid_score", "rank", pos="ordinal", most=top_k)


def hybrid(queries: DataFrame, chunks: DataFrame, top_k: int, mode: str = "rrf", key: str = "chunk_id", k: int = ranking.RRF_K, weights: tuple[float, float] = (ranking.BM25_WEIGHT, ranking.VECTOR_WEIGHT)) -> DataFrame:
    """The ``top_k`` chunks of each query with all their scores; ``mode`` is rrf, weighted or vector.

    Every row of ``chunks`` is a chunk of its own, also those that share an id
    or all their values; ties keep the order of (pos, key). Contents join the
    ``top_k`` at the end. Without chunks there are no rows.
    """
    lists = Lists(queries, chunks, key)
    best = top_rrf(lists, top_k, k) if mode == "rrf" else top_weighted(lists, top_k, *((0.0, 1.0) if mode == "vector" else weights))
    return best.join(lists.chunks, "ordinal").drop("ordinal", "pos")
