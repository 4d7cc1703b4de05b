"""A stored BM25 index: postings by term, in blocks that a question can leave unread.

Chunks lie in buckets; each bucket is a block of postings (term, chunk, tf,
size), with a small table beside it that says for each term how many chunks have
it, its largest tf and the least size. From these follows the most that any
chunk of the block can score, whatever later blocks do to idf and mean size. A
question first scores the blocks that promise most; a block that can't reach its
k-th score so far is not read. Blocks are folders: an update replaces those it
touches, and files of the others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ranking
from tessera.operators.ranking import K1, B
from tessera.sources.tables import written

POSTINGS, BOUNDS, SIZES = "bucket int, term string, pos long, tf long, size int", "bucket int, term string, df long, most_tf long, least_size int", "bucket int, n long, words long"
#: Parameters: blocks that a question reads before it knows its k-th score; terms of all questions that are pushed to the scan by name.
FIRST, NAMED = 2, 2000
#: Parameter: characters of the chunks of one file.
FILE = 8 << 20
#: A block's bound and scores are sums in different order: blocks within this share of the k-th score are read.
SLACK = 1e-9


class TermIndex:
    """``path`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Blocks that the last question read, for those who want to know.
        self.read_blocks: list[int] = []

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, chunks: DataFrame, append: bool = False) -> None:
        """Files (bucket, pos, content): each bucket's block takes the place of the one before, or stands beside it with ``append``.

        A chunk's words are counted in its own row. Chunks are dealt to a
        bucket's files by their places, so that neither a hot bucket nor a hot
        term is one task's, and what is shuffled are texts, not postings.
        """
        rows = dealt(chunks.select("bucket", "pos", "content")).select("bucket", "pos", F.sort_array(T.words("content")).alias("w"))
        counted = _counted(rows.where(F.size("w") > 0))
        postings = counted.select("bucket", "term", "pos", F.col("tf").cast("long").alias("tf"), "size").sortWithinPartitions("bucket", "term", "pos")
        if append:  # what stands there is not counted again
            postings = written(postings, "postings")
        put(postings, f"{self.path}/postings", append)
        n = written(chunks.groupBy("bucket").agg(F.count("*").alias("n")), "n")
        if not append:
            postings = self._read("postings", POSTINGS).join(F.broadcast(n.select("bucket")), "bucket", "left_semi")  # a row for each bucket
        bounds = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.max("tf").alias("most_tf"), F.min("size").alias("least_size"), F.sum("tf").alias("words"))
        bounds = written(bounds, "bounds")  # a range sort reads its input twice
        order = ["bucket", "term"]
        put(bounds.drop("words").repartitionByRange(*order).sortWithinPartitions(*order), f"{self.path}/bounds", append)
        sizes = n.join(bounds.groupBy("bucket").agg(F.sum("words").alias("words")), "bucket", "left").select("bucket", "n", F.coalesce("words", F.lit(0)).alias("words"))
        put(sizes.coalesce(1), f"{self.path}/sizes", append)  # a row for each bucket

    def stats(self) -> DataFrame:
        """One row (n, avgdl)."""
        sizes = self._read("sizes", SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("words").alias("w"))
        return sizes.select("n", (F.col("w") / F.col("n")).alias("avgdl"))

    def _weights(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, idf, avgdl) of the questions' terms, and (query_id, bucket, bound)."""
        terms = queries.select("query_id", F.explode(F.array_distinct(T.words("query"))).alias("term"))
        bounds = self._read("bounds", BOUNDS).join(terms.select("term").distinct(), "term", "left_semi")
        bounds = written(bounds.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("most_tf").alias("tf"), F.min("least_size").alias("size")), "bounds")
        df = bounds.groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = written(terms.join(df, "term").join(F.broadcast(self.stats())).select("query_id", "term", idf.alias("idf"), "avgdl"), "weights")
        most = bounds.join(weights, "term").groupBy("query_id", "bucket").agg(F.sum(self._part()).alias("bound"))
        return weights, written(most, "most")

    @staticmethod
    def _part() -> Column:
        return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))

    def _scores(self, weights: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, pos, bm25_score) in the blocks ``wanted`` (query_id, bucket); only their folders are read."""
        blocks = sorted(b for (b,) in wanted.select("bucket").distinct().collect())  # at most one row for each bucket
        self.read_blocks = sorted({*self.read_blocks, *blocks})
        postings = self._read("postings", POSTINGS).where(F.col("bucket").isin(blocks))
        names = [t for (t,) in weights.select("term").distinct().limit(NAMED + 1).collect()]
        if len(names) <= NAMED:
            postings = postings.where(F.col("term").isin(names))
        rows = postings.join(weights, "term").join(wanted.select("query_id", "bucket"), ["query_id", "bucket"], "left_semi")
        return rows.groupBy("query_id", "pos").agg(F.sum(self._part()).alias("bm25_score"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, pos, bm25_score) of all chunks that share a term with a question (query_id, query)."""
        self.read_blocks = []
        return self._scores(*self._weights(queries))

    def topk(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, pos, bm25_score, rank): the ``k`` best of each question, as if all blocks were read; ties keep the smaller pos."""
        self.read_blocks = []
        weights, bounds = self._weights(queries)
        ranked = ranking.ranked(bounds, "bound", "_n", pos="bucket")
        first = written(self._scores(weights, ranked.where(F.col("_n") < FIRST)), "first")
        kth = ranking.ranked(first, "bm25_score", "rank", most=k).where(F.col("rank") == k - 1).select("query_id", F.col("bm25_score").alias("_kth"))
        rest = ranked.where(F.col("_n") >= FIRST).join(kth, "query_id", "left").where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") * (1 - SLACK)))
        rest = written(rest.select("query_id", "bucket"), "rest")
        return ranking.ranked(first.unionByName(self._scores(weights, rest)), "bm25_score", "rank", most=k)


def _counted(rows: DataFrame) -> DataFrame:
    """(bucket, pos, size, term, tf) of rows with sorted words ``w``: runs of equal ones, each column made once."""
    rows = rows.withColumn("size", F.size("w"))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))))
    rows = rows.withColumn("to", F.concat(F.slice("at", F.lit(2), F.size("at")), F.array("size")))
    runs = F.zip_with("at", "to", lambda a, b: F.struct(F.get("w", a).alias("term"), (b - a).alias("tf")))
    return rows.select("bucket", "pos", "size", F.inline(runs))


def dealt(chunks: DataFrame) -> DataFrame:
    """Chunks (bucket, pos, content, ...) dealt to the tasks that write their bucket's files, a task for each so many characters of them."""
    sizes = written(chunks.groupBy("bucket").agg((F.sum(F.length("content")) / FILE + 1).cast("int").alias("_files")), "files")  # a row for each bucket
    rows = chunks.join(F.broadcast(sizes), "bucket").withColumn("_file", F.pmod(F.xxhash64("pos"), F.coalesce("_files", F.lit(1))))
    return rows.repartition("bucket", "_file").drop("_files", "_file")


def put(df: DataFrame, path: str, append: bool = False) -> None:
    """Writes folders by bucket; those of ``df`` take the place of the ones before, or are added to, and no other is touched."""
    writer = df.write.partitionBy("bucket")
    if append:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
