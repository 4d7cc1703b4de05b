"""Event logs, running ledgers and stateful de-duplication as streams; windows are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LOG_SCHEMA = "run_id string, seq long, ts timestamp, type string, data string"


def log_source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event records from a folder of JSON lines."""
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def append(events: DataFrame, path: str, checkpoint: str):
    """K8: an append-only log by day, instead of a file that every event rewrites."""
    return events.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log lines and updates of the content; works on streams and tables."""
    return events.where("type = 'logs'"), events.where("type <> 'logs'")


def content_state(events: DataFrame) -> DataFrame:
    """The last value of each content key of a run."""
    return split(events)[1].groupBy("run_id", F.col("type").alias("key")).agg(F.max_by("data", "seq").alias("value"))


def running_costs(events: DataFrame, step: str = "type", cost: str = "cost") -> DataFrame:
    """A4: totals by step; as a stream in update or complete mode."""
    return events.groupBy(step).agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))


def first_visits(urls: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """J8 as a stream: each address once within the watermark, so that the state stays bounded."""
    return urls.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url"])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Extension: counts and sums by type and window, with late rows up to ``late``."""
    w = F.window(ts, width)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Extension."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Extension: a user's events with no gap of ``gap`` or more between."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("session_start"), "n", "total")


class Progress(StreamingQueryListener):
    """Section 2.9: counters of a run's streams: batches, rows and what has ended."""

    def __init__(self):
        self.batches, self.rows, self.ended = 0, 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended += 1
