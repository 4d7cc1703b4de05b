"""Operator 5: mixture-controlled packing by deficit round-robin.

Every source has a queue of documents. In each round a source's deficit grows
by its quantum, the window times its target share, and it sends documents while
its deficit covers them; what is left over carries into the next round. A
document therefore leaves in the first round whose quanta together cover its
queue up to and including it: ceil(end / quantum). Prefix sums give ``end``, so
rounds, and the deficits between them, need no sequential pass: they carry
across windows and partitions by arithmetic. The documents, ordered by (round,
source, place), form one stream, which is cut every ``length`` tokens: only the
last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import KEY, Table, prefix_sums, small_batches
from tessera.llm.tokens import WordEncoder

#: Production parameters: tokens of a sequence, tokens of a round (64 sequences), the id that ends a document.
LENGTH, WINDOW, END_ID = 4096, 64 * 4096, 2


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> Table:
    """A written table (doc_id, source, n, ids): each row's ids and the end id, little-endian, of the vocabulary's width."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = WordEncoder(tokenizer)
        end = end_id.to_bytes(encoder.width, "little")
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                ids = [encoder.text_ids(t) + end for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array([len(i) // encoder.width for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "ids"])

    kinds = dict(docs.dtypes)
    texts = small_batches(docs).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return Table(texts.mapInArrow(encode, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n long, ids binary"), "ids")


def schedule(sizes: DataFrame, shares: DataFrame | None = None, window: int = WINDOW, seed: int = 5) -> DataFrame:
    """Rows (key, doc_id, source, n) with ``at``, their place in the packed stream.

    ``shares`` (source, share) are the target proportions; without them they
    are the sources' own, so that all queues end together. A source without a
    share, or with none above 0, comes last.
    """
    queued = prefix_sums(sizes.withColumn("_mix", F.xxhash64(F.lit(seed), "doc_id", "n")), ["source"], ["_mix", "doc_id", *KEY], "n")
    if shares is None:
        shares = queued.groupBy("source").agg(F.sum("n").alias("share"))
    shares = shares.select(F.col("source").alias("_source"), F.col("share").cast("double").alias("_share")).where("_share > 0")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row for each source
    quanta = shares.select("_source", (F.col("_share") / F.sum("_share").over(everything) * window).alias("_quantum"))
    placed = queued.join(quanta, queued["source"].eqNullSafe(quanta["_source"]), "left")
    turn = F.ceil((F.col("before") + F.col("n")) / F.col("_quantum"))
    placed = placed.withColumn("_round", F.coalesce(turn, F.lit(2**62))).drop("_source", "_quantum", "_mix").withColumnRenamed("before", "_place")
    return prefix_sums(placed, [], ["_round", "source", "_place", *KEY], "n", out="at").select(*KEY, "doc_id", "source", "n", "at")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, shares: DataFrame | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, source, text): a row for each piece of a document in a sequence.

    Columns: doc_id, source, sequence_id, offset (in the sequence), start (in
    the document), length, doc_tokens and ids (binary, little-endian). A null
    text is empty: its only id is the end id. Null sources form one queue. Rows
    that repeat are packed as often as they occur; ties take the stored row's
    place. An empty table gives no pieces. A document of any length is cut at
    the sequences' ends only.
    """
    table = encoded(docs, tokenizer, end_id)
    places = schedule(table.read(keys=True).select(*KEY, "doc_id", "source", "n"), shares, window)
    rows = table.read(keys=True).select(*KEY, "ids")
    places = places.select(*[F.col(k).alias(f"_p{k}") for k in KEY], "doc_id", "source", "n", "at")
    both = places.join(rows, (rows[KEY[0]] == places[f"_p{KEY[0]}"]) & (rows[KEY[1]] == places[f"_p{KEY[1]}"])).select("doc_id", "source", "n", "at", "ids")
    width = F.length("ids") / F.col("n")
    pieces = both.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length))))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at"))
    pieces = pieces.withColumn("start", start.cast("long")).withColumn("length", (stop - start).cast("long"))
    own = F.expr("substring(ids, cast(start * (length(ids) / n) + 1 as int), cast(`length` * (length(ids) / n) as int))")
    return pieces.select("doc_id", "source", "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).cast("long").alias("offset"), "start", "length", F.col("n").alias("doc_tokens"), own.alias("ids"), width.cast("int").alias("width"))


def digests(pieces: DataFrame) -> DataFrame:
    """The contract's columns: each piece's ids as the CRC-32 of unsigned 32-bit little-endian words."""
    kinds = dict(pieces.dtypes)

    def crc(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2" if w == 2 else "<u4").astype("<u4").tobytes()) for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("length"), pa.array(sums, pa.int64()), b.column("doc_tokens"), b.column("sequence_id"), b.column("offset")], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(crc, f"doc_id {kinds['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
