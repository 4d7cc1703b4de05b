"""BM25, vector scores, rank fusion, reranking and top-k.

Chunks are (chunk_id, pos, content, embedding, ...), queries (query_id, query,
embedding). ``pos`` is the input order: ties keep it. Only query terms' postings
and a chunk's other words in one row are shuffled. The stated queries' side carries no hint: Spark broadcasts it below
its size threshold and pairs blocks of both sides beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.vector import cosine
from tessera.sources.tables import numbered, written

#: Parameters of BM25 and of rank fusion.
K1, B, RRF_K, BM25_WEIGHT, VECTOR_WEIGHT = 1.5, 0.75, 60, 0.4, 0.6


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, term, tf, size): a row for each distinct word of a chunk."""
    rows = chunks.select(key, T.words(text).alias("w")).withColumn("size", F.size("w"))
    return rows.select(key, "size", F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def corpus_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    """One row (n, avgdl)."""
    return chunks.agg(F.count("*").alias("n"), F.avg(T.word_count(text)).alias("avgdl"))


def bm25(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(query_id, key, bm25_score) of chunks that share a term with the query; the others' score is 0.

    Texts are read once: a chunk's words are counted under the queries' terms,
    all others under null, so that what is shuffled is a row for each term of
    the queries and one more, and the sums are the corpus's.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.words("query"))).alias("term"))
    words = chunks.select(key, T.words(text).alias("w")).select(key, F.size("w").alias("size"), F.explode("w").alias("word"))
    met = words.join(terms.select("term").distinct(), F.col("word") == F.col("term"), "left")
    counts = written(met.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size")), "counts")
    tf = counts.where("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = chunks.agg(F.count("*").alias("n")).join(counts.agg(F.sum("tf").alias("words"))).select("n", F.try_divide("words", "n").alias("avgdl"))
    weighted = tf.join(df, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))
    return weighted.withColumn("part", part).join(terms, "term").groupBy("query_id", key).agg(F.sum("part").alias("bm25_score"))


def vector_scores(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, vector_score) for every pair; the stated queries stream past the chunks.

    Spark makes a column that isn't stored where it is used, here once a pair:
    embed and write the chunks first.
    """
    q = queries.select("query_id", F.col("embedding").alias("query_embedding"))
    return chunks.select(key, "embedding").join(q).select("query_id", key, cosine("query_embedding", "embedding").alias("vector_score"))


def ranked(df: DataFrame, score: str, rank: str, by: str = "query_id", pos: str = "pos", most: int | None = None) -> DataFrame:
    """Adds the 0-based rank by descending score; equal scores keep the input's order.

    With ``most`` the filter stands on the row number itself, so each task keeps
    its own best ``most`` rows and only these meet.
    """
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(pos))))
    out = out if most is None else out.where(F.col(rank) <= most)
    return out.withColumn(rank, F.col(rank) - 1)


def ranked_whole(df: DataFrame, score: str, rank: str, by: str = "query_id", pos: str = "pos") -> DataFrame:
    """As :func:`ranked` for lists of any length: rows are numbered by ranges, so that no list is one task's. Reads ``df`` twice."""
    rows = numbered(df, [F.col(by), F.desc(score), F.asc(pos)], "_n")
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))  # a row for each list
    return rows.join(F.broadcast(first), F.col(by).eqNullSafe(F.col("_by"))).withColumn(rank, F.col("_n") - F.col("_first")).drop("_n", "_by", "_first")


def rrf_score(*ranks: str, k: int = RRF_K) -> Column:
    """The sum of 1 / (k + rank + 1); a missing rank adds nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + F.col(r) + 1), F.lit(0.0))
    return total


def rrf(scored: DataFrame, pos: str = "pos", k: int = RRF_K) -> DataFrame:
    """hybrid_score of rows (query_id, pos, bm25_score, vector_score)."""
    rows = ranked_whole(ranked_whole(scored, "bm25_score", "bm25_rank", pos=pos), "vector_score", "vector_rank", pos=pos)
    return rows.withColumn("hybrid_score", rrf_score("bm25_rank", "vector_rank", k=k))


def weighted(scored: DataFrame, bm25_weight: float = BM25_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Scores over their query's largest, weighted."""
    w = Window.partitionBy("query_id")
    share = lambda s: F.col(s) / F.when(F.max(s).over(w) > 0, F.max(s).over(w)).otherwise(1.0)
    return scored.withColumn("hybrid_score", bm25_weight * share("bm25_score") + vector_weight * share("vector_score"))


def fused_candidates(bm25_ranked: DataFrame, vector_ranked: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Full outer merge of two candidate lists (query_id, key, bm25_rank / vector_rank); a missing side adds 0."""
    both = bm25_ranked.join(vector_ranked, ["query_id", key], "full")
    return both.withColumn("hybrid_score", rrf_score("bm25_rank", "vector_rank", k=k))


def by_text(vector_hits: DataFrame, index: DataFrame) -> DataFrame:
    """Vector hits (content, ...) meet the index (content, index_pos) by their text; of equal texts the last index counts, others drop."""
    last = index.groupBy("content").agg(F.max("index_pos").alias("index_pos"))
    return vector_hits.join(last, "content")


def rerank(query: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """Hits (query_id, pos, embedding) by cosine with their query."""
    q = query.select("query_id", F.col("embedding").alias("query_embedding"))
    scored = hits.drop("rerank_score").join(q, "query_id").withColumn("rerank_score", cosine("query_embedding", "embedding")).drop("query_embedding")
    return ranked(scored, "rerank_score", "rerank_rank", most=top_k)


def rerank_by(query: DataFrame, hits: DataFrame, model, top_k: int) -> DataFrame:
    """As :func:`rerank` by an injected model of (query, content) columns."""
    scored = hits.drop("rerank_score").join(query.select("query_id", "query"), "query_id").withColumn("rerank_score", model(F.col("query"), F.col("content")))
    return ranked(scored, "rerank_score", "rerank_rank", most=top_k)


def sort_score() -> Column:
    """The first positive of rerank and hybrid score, else the vector score."""
    return F.when(F.col("rerank_score") > 0, F.col("rerank_score")).when(F.col("hybrid_score") > 0, F.col("hybrid_score")).otherwise(F.col("vector_score"))


def best_score(hits: DataFrame) -> DataFrame:
    """The largest vector score, 0 without hits."""
    return hits.agg(F.coalesce(F.max("vector_score"), F.lit(0.0)).alias("best"))
