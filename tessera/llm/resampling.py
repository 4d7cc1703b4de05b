"""Operator 11: importance resampling towards a target distribution.

Features are hashed runs of words, counted over all documents and over the
target's texts. A document's weight is the mean log ratio of its features'
shares in both; weights with Gumbel noise are ranked, and the first rows are a
draw without replacement in proportion to the weights.

Long texts are chunked with overlap: cut at word boundaries, each chunk with
the n-1 words that follow it. A chunk owns the runs that start in it, so that
sums over a document's chunks are the document's own; chunks are dealt out
anew, and no task holds more of a long text than a few of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEY, Table, aside, keyed, prefix_sums, small_batches

#: Production parameters: longest run of words, buckets, percent drawn, words that a drawn document has at least, seed of the noise.
NGRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, "2024"
#: Parameter: texts of more bytes than this are chunked, at about this size.
CHUNK = 2**16
#: Parameter: distinct features that a worker keeps in a table before it starts anew.
MOST_KEPT = 500_000

#: What is no part of a word turns into a blank, A-Z into a-z; all bytes from 0x80 on belong to words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INSIDE, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def overlapping(text: bytes, size: int, n: int) -> Iterator[tuple[bytes, bytes]]:
    """(chunk, the n-1 words after it) for pieces of at least ``size`` bytes that end where a word does; a word is never cut, however long."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        after = INSIDE.finditer(text, end)
        yield text[start:end], b" ".join(w[0] for w, _ in zip(after, range(n - 1), strict=False))
        start = end


def features(text: bytes, carry: bytes, n: int) -> tuple[int, list[bytes]]:
    """How many words ``text`` has, and the runs of 1 to ``n`` words that start in it; the last may end in ``carry``."""
    own = text.translate(PLAIN).split()
    if n == 1:
        return len(own), own
    words = own + carry.translate(PLAIN).split()
    return len(own), [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(min(len(own), len(words) - k + 1))]


class Kept(dict):
    """A feature's value, computed once and kept in a table of bounded size."""

    def __init__(self, value: Callable[[bytes], int]):
        super().__init__()
        self.value = value

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MOST_KEPT:
            self.clear()
        made = self[feature] = self.value(feature)
        return made


def chunks(docs: DataFrame, n: int = NGRAMS, size: int = CHUNK) -> DataFrame:
    """Long texts of ``docs`` (_file, _row, doc_id, text) as (_file, _row, doc_id, chunk, text, carry), dealt out by key and chunk."""
    kind = dict(docs.dtypes)["doc_id"]

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c) for c in [*KEY, "doc_id"]]
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                held, full = [], 0
                for number, (piece, carry) in enumerate(overlapping(text.as_py(), size, n)):
                    held.append((number, piece, carry))
                    full += len(piece)
                    if full > 64 * size:
                        yield _rows(columns, i, held)
                        held, full = [], 0
                if held:
                    yield _rows(columns, i, held)

    def _rows(columns: list, i: int, held: list):
        import pyarrow as pa

        same = [c.take(pa.array([i] * len(held))) for c in columns]
        number, piece, carry = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*same, pa.array(number, pa.int32()), pa.array(piece, pa.binary()), pa.array(carry, pa.binary())], names=[*KEY, "doc_id", "chunk", "text", "carry"])

    made = docs.select(*KEY, "doc_id", "text").mapInArrow(split, f"_file long, _row long, doc_id {kind}, chunk int, text binary, carry binary")
    return made.repartition(*KEY, "chunk")


def bucket_counts(pieces: DataFrame, n: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of ``pieces`` (text, carry: binary); a task gives a row for each bucket, once."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen, sums = Counter(), np.zeros(buckets, np.int64)

        def flush() -> None:
            for feature, times in seen.items():
                sums[zlib.crc32(feature) % buckets] += times
            seen.clear()

        for batch in batches:
            for text, carry in zip(batch.column("text"), batch.column("carry"), strict=True):
                seen.update(features(text.as_py(), carry.as_py(), n)[1])
                if len(seen) > MOST_KEPT:
                    flush()
        flush()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], names=["bucket", "n"])

    counted = pieces.select("text", "carry").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, in thousandths; the driver gets ``buckets`` numbers, whatever the corpus."""
    s, t = (df.select("bucket", F.col("n").alias(c)) for df, c in ((own, "s"), (target, "t")))
    rows = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    total = rows.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    ratio = f"(t + 1D) * (s_all + {buckets}D) / ((s + 1D) * (t_all + {buckets}D))"
    gains = rows.join(F.broadcast(total)).select("bucket", F.expr(f"floor(1000 * ln({ratio}))").alias("gain")).collect()
    return [g for _, g in sorted(gains)]


def weighed(pieces: DataFrame, gains: list[int], n: int = NGRAMS) -> DataFrame:
    """(_file, _row, doc_id, n_words, n_features, total) of each piece."""
    kind = dict(pieces.dtypes)["doc_id"]

    def weigh(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gain = Kept(lambda feature: gains[zlib.crc32(feature) % len(gains)]).__getitem__
        for batch in batches:
            made = []
            for text, carry in zip(batch.column("text"), batch.column("carry"), strict=True):
                words, found = features(text.as_py(), carry.as_py(), n)
                made.append((words, len(found), sum(map(gain, found))))
            sums = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*KEY, "doc_id"]], *sums], names=[*KEY, "doc_id", "n_words", "n_features", "total"])

    return pieces.select(*KEY, "doc_id", "text", "carry").mapInArrow(weigh, f"_file long, _row long, doc_id {kind}, n_words long, n_features long, total long")


def _pieces(rows: DataFrame, n: int, size: int) -> tuple[DataFrame, Table]:
    """Short texts where they lie; long ones chunked, dealt out and written, as they are gone through twice."""
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    short = small_batches(rows).where(length <= size).select(*KEY, "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(b"").alias("carry"))
    return short, Table(chunks(rows.where(length > size), n, size), "chunks")


def importance(docs: DataFrame, target: DataFrame, n: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, size: int = CHUNK) -> DataFrame:
    """Rows (_file, _row: the key of :func:`keyed`, doc_id, n_words, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text) against ``target`` (text).

    ``rank`` counts the drawn rows from 1 by descending score, ties to the
    smaller doc_id, then to the earlier stored row; it is null for all others.
    A null or empty text has no features and weight 0; a null doc_id has the
    noise of an empty name and comes first among ties. An empty target, or an
    empty table of documents, gives gains by its zero counts, and no rows.
    Repeated rows are scored, and may be drawn, as often as they occur.
    """
    rows = docs if set(KEY) <= set(docs.columns) else keyed(docs.select("doc_id", "text"))
    short, long_ = _pieces(rows, n, size)
    texts, aims = ["text", "carry"], target.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(b"").alias("carry"))
    gains = bucket_gains(bucket_counts(short.select(texts).unionByName(long_.read().select(texts)), n, buckets), bucket_counts(aims, n, buckets), buckets)
    whole = weighed(small_batches(long_.read()), gains, n).groupBy(*KEY, "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    mean = F.expr("if(n_features = 0, 0, (total - pmod(total, nullif(n_features, 0))) div nullif(n_features, 0))")
    noise = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = weighed(short, gains, n).unionByName(whole).withColumn("weight", mean).withColumn("score", score).drop("total")
    able = F.col("n_words") >= least_words
    scored = Table(scored.withColumn("_able", able.cast("long")).withColumn("_out", (~able).cast("int")).withColumn("_down", -F.col("score")), "scores")
    long_.drop()
    most = scored.read().where("_able = 1").count() * percent // 100
    placed = prefix_sums(scored.read(), [], ["_out", "_down", "doc_id", *KEY], "_able")
    rank = F.when((F.col("_able") == 1) & (F.col("before") < most), F.col("before") + 1)
    return placed.withColumn("rank", rank.cast("long")).select(*KEY, "doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` (doc_id, text, ...) with the columns they came with."""
    inner, back = aside(docs, ["doc_id", "text"])
    rows = keyed(inner)
    drawn = importance(rows, target, **options).where("rank is not null").select(*[F.col(k).alias(f"_p{k}") for k in KEY])
    return back(rows.join(drawn, (rows[KEY[0]] == drawn[f"_p{KEY[0]}"]) & (rows[KEY[1]] == drawn[f"_p{KEY[1]}"]), "left_semi"))
