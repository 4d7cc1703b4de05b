"""Session builder with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime re-planning, Arrow transfer, UTC and last-wins maps.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on ``master``; on a cluster pass the cluster's own settings in ``more``."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
