"""A partitioned inverted-file index of vectors.

Cells come from k-means on the directions of a bounded sample; every row is
filed in the folder of its nearest cell, beside a table that says for each cell
its centre and the widest angle at which a row of it lies. A question reads the
folders of its nearest cells and rescores their rows exactly, in blocks
(:mod:`tessera.operators.pairs`) that give out the best rows only. By the triangle
inequality of angles no row of a cell comes nearer than the angle to the centre
less the cell's widest, so that an exact search knows which further cells could
hold one of the k best, and reads those and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vector import cosine, norm
from tessera.operators import pairs, ranking
from tessera.sources.tables import written

#: Parameters: rows of the sample that cells are fitted on, most cells, rounds of k-means, and the cell of rows that have no direction or other dimensions.
SAMPLE, MOST_CELLS, ROUNDS, OTHER = 20_000, 4096, 12, -1
#: Parameters: share of the cells that a question reads at once in an exact search, and in all in an approximate one (measured recall: 0.95 on vectors without clusters).
PROBES, APPROXIMATE = 0.25, 0.75
#: Angles are known to so many radians.
SLACK = 1e-6


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length 1: spherical k-means from the first ``cells`` rows; a centre without rows stays."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def cells_for(n: int) -> int:
    """As many cells as rows in each, up to MOST_CELLS, and at least eight rows of the sample for each."""
    return max(1, min(MOST_CELLS, round(n**0.5), min(n, SAMPLE) // 8))


class VectorIndex:
    """``path`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: What the rows are like; known where they were filed, and else told by the files, of which an empty index has none.
        self.schema = None
        #: Cells that the last search read.
        self.read_cells: list[int] = []

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None) -> VectorIndex:
        """Files every row of ``vectors`` (key, embedding, ...); the driver holds the sample and the centres, whatever the number of rows."""
        index, spark = cls(vectors.sparkSession, path), vectors.sparkSession
        usable = vectors.where((F.size("embedding") > 0) & (norm(F.col("embedding").cast("array<double>")) > 0))
        picked = usable.select(F.xxhash64(key, "embedding").alias("_h"), F.col("embedding").cast("array<double>").alias("e")).orderBy("_h").limit(SAMPLE).collect()
        sizes = [len(r.e) for r in picked]
        dims = max(set(sizes), key=sizes.count) if sizes else 0
        sample = np.array([r.e for r in picked if len(r.e) == dims], np.float64).reshape(-1, max(dims, 1))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        centres = fitted(sample, min(cells or cells_for(usable.count()), max(len(sample), 1))) if len(sample) else np.zeros((0, 1))

        def file(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                rows = batch.column("_e").to_pylist()
                cell, angle = np.full(len(rows), OTHER, np.int32), np.full(len(rows), np.pi)
                at = [i for i, e in enumerate(rows) if e is not None and len(e) == dims and None not in e and any(e)]
                if at and len(centres):
                    m = np.array([rows[i] for i in at], np.float64)
                    near = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ centres.T
                    cell[at] = near.argmax(1)
                    angle[at] = np.arccos(np.clip(near.max(1), -1, 1))
                columns = [batch.column(c) for c in batch.schema.names if c != "_e"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell), pa.array(angle)], names=[*[c for c in batch.schema.names if c != "_e"], "cell", "angle"])

        kinds = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
        filed = vectors.withColumn("_e", F.col("embedding").cast("array<double>")).mapInArrow(file, f"{kinds}, cell int, angle double")
        filed = written(filed, "filed")
        index.schema = filed.schema
        # a cell of very many rows is written by several tasks
        filed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("cell").parquet(f"{index.path}/rows")
        widest = filed.groupBy("cell").agg(F.max("angle").alias("widest"), F.count("*").alias("n"))
        named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        widest.join(named, "cell", "left").write.parquet(f"{index.path}/cells")
        return index

    def rows(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """(cell, widest, n, centre): a row for each cell, MOST_CELLS and one at most."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def _scored(self, wanted: DataFrame, queries: DataFrame, key: str, k: int = 1) -> DataFrame:
        """Exact likeness of each question to rows of its cells, the ``k`` best among them; other folders are not read."""
        cells = sorted(c for (c,) in wanted.select("cell").distinct().collect())
        self.read_cells = sorted({*self.read_cells, *cells})
        rows = self.rows().where(F.col("cell").isin(cells)).select(key, "embedding", "cell")
        asked = wanted.groupBy("query_id").agg(F.array_sort(F.collect_set("cell")).alias("cells")).join(queries.select("query_id", "embedding"), "query_id")
        return pairs.meeting(written(asked, "asked"), rows, k, key=key, within=True)

    def search(self, queries: DataFrame, k: int, probes: float | None = None, exact: bool = True, key: str = "chunk_id") -> DataFrame:
        """(query_id, key, vector_score, rank): the ``k`` nearest of each question (query_id, embedding); ties keep the smaller key.

        Reads the nearest cells first, a share of ``probes`` of all; an exact
        search then reads each cell that could still hold a row as near as the
        k-th so far, so that its result is that of scoring every pair.
        """
        self.read_cells = []
        q = F.col("query.embedding").cast("array<double>")
        turned = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(q, F.col("cells.centre")))))
        met = queries.alias("query").join(self.cells().alias("cells"))  # questions by cells, no rows
        usable = F.col("cells.centre").isNotNull() & (F.size("query.embedding") == F.size("cells.centre")) & (norm(q) > 0)
        # a row of cell OTHER, or any row to a question of other dimensions or none, has likeness 0, but for other rows of its own length
        nearest = F.when(usable, F.cos(F.greatest(F.lit(0.0), turned - F.col("widest") - SLACK))).otherwise(F.when(F.col("cells.cell") == OTHER, 1.0).otherwise(0.0))
        far = written(met.select("query.query_id", "cells.cell", F.when(usable, turned).otherwise(F.acos(F.lit(0.0))).alias("turned"), nearest.alias("bound")), "far")
        ordered = ranking.ranked(far.withColumn("_near", -F.col("turned")), "_near", "_n", pos="cell")
        most = max(1, round((probes or (PROBES if exact else APPROXIMATE)) * self.cells().count()))
        first = written(self._scored(ordered.where(F.col("_n") < most), queries, key, k), "near")
        if not exact:
            return ranking.ranked(first, "vector_score", "rank", pos=key, most=k)
        kth = ranking.ranked(first, "vector_score", "rank", pos=key, most=k).where(F.col("rank") == k - 1).select("query_id", F.col("vector_score").alias("_kth"))
        rest = ordered.where(F.col("_n") >= most).join(kth, "query_id", "left").where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - SLACK))
        rest = written(rest.select("query_id", "cell"), "rest")
        return ranking.ranked(first.unionByName(written(self._scored(rest, queries, key, k), "far")), "vector_score", "rank", pos=key, most=k)
