"""Operator 6: token counts with a digest cache.

A text's digest covers its normalised content (runs of white space are one
space) and the tokenizer's version. Digests join the cache's stored counts;
only distinct digests that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, Table, cut, shared_dir, small_batches
from tessera.llm.tokens import WordEncoder, version_digest

SCHEMA = "digest binary, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder that all executors share; it is created where it is
    missing, and without one the call has a cache of its own that goes with the
    session. An append writes
    whole files only, so a failed run leaves nothing half-counted; a count that
    two runs append twice is read once. A null text is empty (0 tokens); an
    empty table gives no rows; repeated rows count each; other columns are
    ignored.
    """
    spark = small_batches(docs).sparkSession
    cache = cache or Table.at(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}").path
    version = version_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    normal = F.trim(F.regexp_replace(text, SPACES, " "))
    named = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(F.lit(version), normal), 256)).alias("digest"), text.alias("text"))
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(SCHEMA).parquet(cache)
    misses = named.join(stored, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = WordEncoder(tokenizer)
        for b in batches:
            counts = [len(encoder.text_ids(t)) // encoder.width for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    misses.mapInArrow(encode, SCHEMA).write.mode("append").parquet(cache)
    # written, so that nothing but a shuffle stands below the join and a digest of very many rows can be split
    counts = cut(spark.read.schema(SCHEMA).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return named.drop("text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
