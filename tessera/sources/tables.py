"""Tables in the folder that all executors share: where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a local one only where neither is named and no executor is elsewhere, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = kept.get() if kept.isDefined() else f"file://{tempfile.gettempdir()}/checkpoints"
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read again: a lost executor re-reads files, and nothing is made twice."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], out: str = "ordinal") -> DataFrame:
    """Adds each row's number from 0 in ``order``; equal rows in any order, each with a number of its own.

    Ranges are sorted apart; one row for each range meets in the window that
    says where the range starts.
    """
    inside = Window.partitionBy("_range").orderBy(*order)
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = ranges.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_range")
    return written(rows.withColumn(out, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start"), "numbered")
