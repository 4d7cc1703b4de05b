"""A persistent chunk store on Parquet: upsert by source, retrieval.

Chunks lie in folders by a hash of their source, the index of terms beside them
in the same buckets. A change rewrites the buckets of the sources it names, by
Spark's dynamic partition overwrite, from a staged copy; all other files stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vector import Embed, cosine, with_embedding
from tessera.operators import chunking, dedup, fusion, ranking
from tessera.plans.term_index import TermIndex, dealt, put
from tessera.sources import files
from tessera.sources.tables import written

SCHEMA = "chunk_id string, pos long, content string, source string, title string, doc_type string, chunk_index int, metadata map<string,string>, embedding array<float>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

#: Parameters: buckets of a store, fixed when it is made; the bucket of chunks without a source, which are only ever added to.
BUCKETS, UNNAMED = 64, -1


class ChunkStore:
    """``path`` is a folder that all executors share. One writer at a time; readers see a bucket before or after a change."""

    def __init__(self, spark: SparkSession, path: str, embed: Embed, buckets: int = BUCKETS):
        self.spark, self.path, self.embed, self.buckets = spark, path.rstrip("/"), embed, buckets
        self.index = TermIndex(spark, f"{self.path}/index")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _bucket(self, source: str = "source"):
        return F.when(F.col(source) == "", UNNAMED).otherwise(F.pmod(F.xxhash64(source), F.lit(self.buckets))).cast("int")

    def _exists(self, name: str) -> bool:
        at = self._fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self._conf).exists(at)

    def filled(self) -> bool:
        return self._exists("chunks")

    def _stored(self) -> DataFrame:
        if not self.filled():
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/chunks")

    def chunks(self) -> DataFrame:
        """A scan; predicates and columns are pushed to it."""
        return self._stored().select(*COLUMNS)

    def _replace(self, rows: DataFrame, append: bool = False, staged: bool = False) -> None:
        """Puts ``rows`` (with bucket) and their index in place; they are written aside first, so that no file is read that is being replaced, unless they are ``staged`` already."""
        rows = rows.select(*COLUMNS, "bucket")
        rows = rows if staged else written(rows, "staged")
        put(dealt(rows), f"{self.path}/chunks", append)
        self.index.write(rows, append)

    def add(self, chunks: DataFrame, doc_type: str = "local", order: str | None = None) -> int:
        """K1: replaces the sources that ``chunks`` name; chunks without a source are only added. Returns how many were added.

        Their places follow the column ``order``; without one, the order in
        which Spark reads them, which for a table of several files is any.
        """
        chunks = chunks.orderBy(order).drop(order) if order else chunks
        extra = F.col("metadata") if "metadata" in chunks.columns else F.lit(None).cast("map<string,string>")
        new = with_embedding(chunks, self.embed)
        new = new.select(F.expr("uuid()").alias("chunk_id"), F.monotonically_increasing_id().alias("pos"), "content", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("title", F.lit("")).alias("title"), F.lit(doc_type).alias("doc_type"), F.col("chunk_index").cast("int").alias("chunk_index"), F.map_filter(extra, lambda _, v: v.isNotNull()).alias("metadata"), F.col("embedding").cast("array<float>").alias("embedding"))
        new = written(new.withColumn("bucket", self._bucket()), "added")  # ids are given once
        old = self._stored()
        start = old.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
        new = new.withColumn("pos", F.col("pos") + F.lit(start))
        counts = {b: n for b, n in new.groupBy("bucket").count().collect()}  # at most one row for each bucket
        touched = [b for b in counts if b != UNNAMED]
        if touched and not self.filled():
            self._replace(new.where(F.col("bucket") != UNNAMED), staged=True)
        elif touched:
            kept = old.where(F.col("bucket").isin(touched)).join(new.select("source").distinct(), "source", "left_anti")
            self._replace(kept.unionByName(new.where(F.col("bucket") != UNNAMED)))
        if UNNAMED in counts:
            self._replace(new.where(F.col("bucket") == UNNAMED), append=True, staged=True)
        return sum(counts.values())

    def delete(self, source: str) -> int:
        """K2: rewrites the source's bucket; a bucket that is left empty goes. Chunks without a source go one and all."""
        one = self.spark.range(1).select(F.lit(source).alias("source"))
        bucket = one.select(self._bucket()).first()[0]
        rows = self._stored().where(F.col("bucket") == bucket)
        n = rows.where(F.col("source") == source).count()
        rest = rows.where(F.col("source") != source)
        if n and not rest.isEmpty():
            self._replace(rest)
        elif n:
            for name in ("chunks", "index/postings", "index/bounds", "index/sizes"):
                at = self._fs.Path(f"{self.path}/{name}/bucket={bucket}")
                at.getFileSystem(self._conf).delete(at, True)
        return n

    def load(self, docs: DataFrame, size: int = 1000, overlap: int = 200) -> int:
        """K3: documents (doc_id, url, title, raw_content), split and added in the order of their ids."""
        return self.add(chunking.fixed_chunks(docs.orderBy("doc_id"), size, overlap))  # pieces keep the order of their texts

    def ingest(self, paths: str | list[str]) -> int:
        """Files, chunked by their structure; 0 if there is nothing."""
        docs = files.load(self.spark, paths, require=False)
        if docs.isEmpty():
            return 0
        docs = docs.withColumn("doc_id", F.xxhash64("url", "raw_content"))
        return self.add(chunking.adaptive_chunks(docs))

    def sources(self) -> DataFrame:
        """A1, in order of first appearance."""
        return dedup.catalog(self.chunks()).orderBy("first_pos")

    def count(self) -> int:
        """A2."""
        return self.chunks().count()

    def retrieve(self, queries: DataFrame, top_k: int = 10, k: int = ranking.RRF_K) -> DataFrame:
        """The ``top_k`` of each query by rank fusion of BM25 and the 3 * top_k nearest vectors; all scores are returned.

        The index gives the scores by words, once, rounded before they are
        ordered, so that copies tie: a chunk that is neither among the ``top_k``
        best of them nor among the nearest has less than each of them. What the
        nearest have as rank by words is counted (:func:`fusion.ranks_of`), and
        contents join the ``top_k`` at the end.
        """
        asked = with_embedding(queries, self.embed, "query")
        columns = ["query_id", *COLUMNS[:-1], "embedding", "vector_score", "vector_rank", "bm25_score", "bm25_rank", "hybrid_score", "rank"]
        if not self.filled():
            empty = self.chunks().join(queries.select("query_id").limit(0)).select("*", *[F.lit(0.0).alias(c) for c in columns if c.endswith("score")], *[F.lit(0).cast("long").alias(c) for c in columns if c.endswith("rank")])
            return empty.select(*columns)
        chunks = self.chunks()
        pairs = ranking.vector_scores(asked, chunks, "pos").withColumn("vector_score", F.round("vector_score", fusion.DIGITS))
        near = written(ranking.ranked(pairs, "vector_score", "vector_rank", most=3 * top_k), "near")
        words = written(self.index.scores(asked).select("query_id", F.col("pos").alias("ordinal"), F.round("bm25_score", fusion.DIGITS).alias("score")), "words")
        both = near.select("query_id", F.col("pos").alias("ordinal")).join(words, ["query_id", "ordinal"])
        best = ranking.ranked(words, "score", "_n", pos="ordinal", most=top_k).drop("_n")
        said = fusion.ranks_of(written(best.unionByName(both).dropDuplicates(["query_id", "ordinal"]), "said"), words, "bm25_rank").select("query_id", F.col("ordinal").alias("pos"), F.col("score").alias("bm25_score"), "bm25_rank")
        fused = ranking.fused_candidates(said, near, "pos", k).fillna(0.0, ["bm25_score", "vector_score"])
        top = ranking.ranked(fused, "hybrid_score", "rank", most=top_k)
        return top.join(chunks, "pos").select(*columns)

    def similar(self, queries: DataFrame, k: int = 8, where: dict | None = None) -> DataFrame:
        """Nearest chunks under equalities; a source's are looked for in its bucket alone."""
        rows = self._stored()
        for name, value in (where or {}).items():
            rows = rows.where(F.col(name) == F.lit(value))
            if name == "source" and value is not None:
                bucket = self.spark.range(1).select(F.lit(value).alias("source")).select(self._bucket()).first()[0]
                rows = rows.where(F.col("bucket") == bucket)
        asked = with_embedding(queries, self.embed, "query").select("query_id", F.col("embedding").alias("_q"))
        scored = rows.select("pos", "embedding").join(asked).select("query_id", "pos", cosine("_q", "embedding").alias("vector_score"))
        return ranking.ranked(scored, "vector_score", "rank", most=k).join(rows.select(*COLUMNS), "pos")
