"""Functions of rows over Arrow batches, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: Parameter: rows that are Python objects at once; a batch of Spark's, up to 64 MB, stays as it came.
ROWS = 64


def by_rows(f: Callable, kind: str, arrow: pa.DataType):
    """A column function of ``f``, which takes one row's values; ``kind`` and ``arrow`` are one type."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for n in range(0, len(columns[0]), ROWS):
                yield pa.array([f(*row) for row in zip(*(c.slice(n, ROWS).to_pylist() for c in columns), strict=True)], arrow)

    return run.asNondeterministic()  # what a filter and a column share is made once
