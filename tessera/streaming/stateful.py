"""State that outlives a watermark, and totals that survive a repeated batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstVisit(StatefulProcessor):
    """Emits an address's earliest row of the batch in which it is first seen; later rows, late or not, find it visited."""

    def __init__(self, order: str, ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield min(rows, key=lambda r: (r[self.order] is not None, r[self.order]))

    def handleInitialState(self, key, row, timer) -> None:  # noqa: N802
        self.seen.update((True,))

    def close(self) -> None:
        pass


def visited_once(urls: DataFrame, order: str, visited: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Of a stream (url, ...) each address once, across batches and restarts of its checkpoint.

    State is kept by address, so it spreads over all tasks; ``visited`` (url)
    is what earlier runs have seen, taken over when the checkpoint is new.
    With ``ttl_ms`` an address is forgotten so long after its visit, which
    bounds the state; without it nothing is. Of one batch's rows of an address
    the first by ``order`` counts, nulls first. A null address is one too.
    """
    schema = StructType(urls.schema.fields)
    state = None if visited is None else visited.select("url").distinct().groupBy("url")
    return urls.groupBy("url").transformWithState(FirstVisit(order, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None", state)


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what ``stream`` has by now to ``path``, as Parquet, with its state in RocksDB; the session's own choice of a store is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER[0])
    conf.set(*PROVIDER)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER[0], before)
    query.awaitTermination()


class Ledger:
    """A4: totals by step in a shared folder, exact though a batch may come twice.

    A batch's own totals lie in a folder of its number, which a repeated batch
    overwrites; they are never added to what is there. When more than KEPT
    folders stand, a snapshot takes the place of all but the last: a stream
    repeats no batch but its last. Folders below a snapshot don't count, so a
    writer that stops between its two steps leaves the totals right.
    """

    KEPT = 20
    SCHEMA = "step string, cost double, n long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _numbers(self, kind: str) -> list[int]:
        at = self._fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self._conf)
        names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName()) for p in names if fs.exists(self._fs.Path(p, "_SUCCESS")))

    def _rows(self) -> tuple[list[int], list[int], DataFrame]:
        upto = self._numbers("upto")[-1:]
        batches = [b for b in self._numbers("batch") if not upto or b > upto[0]]
        paths = [*[f"{self.path}/upto/{u}" for u in upto], *[f"{self.path}/batch/{b}" for b in batches]]
        return upto, batches, self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        """(step, cost, n)."""
        return self._rows()[2].groupBy("step").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes rows (step, cost) as batch ``number``; numbers at or below the last snapshot's are known already."""
        upto = self._numbers("upto")
        if upto and number <= upto[-1]:
            return
        totals = batch.groupBy("step").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
        totals.write.mode("overwrite").parquet(f"{self.path}/batch/{number}")
        _, batches, _ = self._rows()
        if len(batches) > self.KEPT:
            self._snapshot(batches[-2])

    def _snapshot(self, upto: int) -> None:
        last, batches, _ = self._rows()
        paths = [*[f"{self.path}/upto/{u}" for u in last], *[f"{self.path}/batch/{b}" for b in batches if b <= upto]]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths).groupBy("step").agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"))
        rows.write.mode("overwrite").parquet(f"{self.path}/upto/{upto}")
        for path in paths:
            at = self._fs.Path(path)
            at.getFileSystem(self._conf).delete(at, True)

    def follow(self, costs: DataFrame, checkpoint: str) -> StreamingQuery:
        """A query that merges a stream (step, cost) batch by batch, to the end of what is there."""
        return costs.writeStream.foreachBatch(lambda df, number: self.merge(df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
