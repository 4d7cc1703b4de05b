"""Operator 8: repeated long spans by a compacted de Bruijn graph of words.

A k-mer, k consecutive words of one document, is an edge of the graph from the
node of its first to the node of its last k - 1 words. As in
minimizer-partitioned compaction (Chikhi et al. 2016), consecutive edges that
share their minimizer, the least-hashed short word run inside, travel as one
piece: never more than ``k - short + 1`` edges, all different. Joins over the
pieces then find the repeated edges:

1. A minimizer that occurs once has no repeated edge.
2. A piece that occurs twice or more is repeated as a whole.
3. Where one minimizer has different pieces, the graph branches: one occurrence
   of each such piece is unfolded into its edges, and the edges that two of them
   share are repeated; each is a piece of its own.

The repeated pieces are the graph's edges from here on. A node that one piece
enters and one leaves doesn't branch: Spark joins link the two, and doubling
pointers along these links gives every piece its nonbranching path and its place
there (:func:`compacted`). Occurrences that follow each other both in the text
and on a path are one span.

What verifies a span are its source coordinates (row, first word, words): pieces
are compared by BLAKE2b digests of 128 bits of the very words that stand there,
one space between them, so no pattern of words can make two differing spans
equal. Numpy hashes only choose minimizers and name nodes: they decide how the
graph is parted and joined, never what is repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import KEY, Table, drop_since, keyed, small_batches
from tessera.llm.hashing import GROUP, Runs, chained, word_hashes

#: Production parameters: words of an edge and of a minimizer; words of a long text that are handled at a time.
K, SHORT, PIECE = 35, 8, 1 << 21
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def pieces(hashes: np.ndarray, firsts: np.ndarray, k: int, short: int) -> tuple[np.ndarray, ...]:
    """The pieces of a group of texts: text, first word in it, edges, minimizer, and the nodes they begin and end at."""
    n, width = len(hashes), k - short + 1
    if n < k:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    minis = chained(hashes, np.arange(n - short + 1), short, 1)
    # upper bits of the hash, then the place: the least value is the leftmost least hash
    least = (minis >> np.uint64(24) << np.uint64(24)) | np.arange(len(minis), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: n - k + 1], least[width - span : width - span + n - k + 1])
    starts = np.arange(n - k + 1)
    text = np.searchsorted(firsts, starts, "right") - 1
    starts = starts[starts + k <= firsts[text + 1]]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    text, least = text[starts], least[starts]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    begin, edges = starts[new], np.diff(np.r_[new, len(starts)])
    stop = begin + edges + k - 1
    mini = minis[(least[new] & np.uint64(0xFFFFFF)).astype(np.int64)]
    nodes = Runs(hashes, 2)
    return text[new], begin - firsts[text[new]], edges, mini, nodes.of(begin, begin + k - 1), nodes.of(stop - k + 1, stop)


class Spoken:
    """Texts by their words: digests of spans of words."""

    def __init__(self, texts: list[bytes]):
        self.lines = [_BLANKS.sub(b" ", t).strip() if len(t) > GROUP else b" ".join(t.split()) for t in texts]
        self.at = [np.r_[0, np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20) + 1, len(line) + 1] for line in self.lines]

    def digests(self, text: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Two numbers for each span of words ``begin`` to ``stop``; ``text`` ascends."""
        out = []
        for t in np.unique(text).tolist():
            own, line = slice(*np.searchsorted(text, [t, t + 1])), self.lines[t]
            lows, highs = self.at[t][begin[own]].tolist(), (self.at[t][stop[own]] - 1).tolist()
            out += [hashlib.blake2b(line[low:high], digest_size=16).digest() for low, high in zip(lows, highs, strict=True)]
        return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def cut_long(hashes: np.ndarray, firsts: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A group as it is, or the pieces of one long text; pieces share k - 1 words, so that each edge is in one piece."""
    if len(hashes) <= PIECE:
        yield hashes, firsts, 0
        return
    for at in range(0, len(hashes) - k + 1, PIECE):
        part = hashes[at : at + PIECE + k - 1]
        yield part, np.array([0, len(part)]), at


def _piece_rows(k: int, short: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            files, places = b.column(KEY[0]).to_numpy(), b.column(KEY[1]).to_numpy()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for first, last, hashes, firsts in word_hashes(texts):
                spoken = Spoken(texts[first:last])
                for part, bounds, at in cut_long(hashes, firsts, k):
                    text, begin, edges, mini, u, v = pieces(part, bounds, k, short)
                    begin = begin + at
                    digests = spoken.digests(text, begin, begin + edges + k - 1)
                    columns = [files[text + first], places[text + first], begin, edges.astype(np.int32), mini.view(np.int64), u.view(np.int64), v.view(np.int64), digests[:, 0], digests[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "begin", "edges", "mini", "u", "v", "s1", "s2"])

    return rows


def _edge_rows(k: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            files, places, wanted = b.column(KEY[0]).to_numpy(), b.column(KEY[1]).to_numpy(), b.column("wanted").to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for first, last, hashes, firsts in word_hashes(texts):
                nodes, spoken = Runs(hashes, 2), Spoken(texts[first:last])
                begins = [(i - first, w["begin"], w["edges"], w["alone"]) for i in range(first, last) for w in wanted[i]]
                text, begin, edges, alone = (np.array(x) for x in zip(*begins, strict=True))
                each = np.repeat(np.arange(len(text)), edges)
                step = np.arange(len(each)) - np.repeat(np.cumsum(edges) - edges, edges)
                text, begin = text[each], begin[each] + step
                digests, at = spoken.digests(text, begin, begin + k), firsts[text] + begin
                columns = [files[text + first], places[text + first], begin, alone[each], nodes.of(at, at + k - 1).view(np.int64), nodes.of(at + 1, at + k).view(np.int64), digests[:, 0], digests[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "begin", "alone", "u", "v", "s1", "s2"])

    return rows


#: A piece's identity, and its path's.
PIECE_ID, PATH = ["s1", "s2"], ["p1", "p2"]


def compacted(found: DataFrame) -> DataFrame:
    """Nonbranching paths of distinct pieces (s1, s2, u, v, edges): each piece's path, named by its first piece, and its offset there in edges.

    A node is inner to a path if one piece enters it and one leaves it. Each
    round doubles how far a piece's pointer reaches back, so rounds grow with
    the logarithm of the longest path; only a path of its own length is ever
    followed, and a node that very many pieces share is only counted. A cycle
    has no first piece: its pieces stay paths of their own.
    """
    table = Table(found, "pieces-of")
    leaving = table.read().groupBy("u").agg(F.count("*").alias("n"), F.min(F.struct(*PIECE_ID)).alias("s")).where("n = 1")
    entering = table.read().groupBy(F.col("v").alias("u")).agg(F.count("*").alias("n"), F.min(F.struct(*PIECE_ID, "edges")).alias("p")).where("n = 1")
    links = leaving.drop("n").join(entering.drop("n"), "u").select("s.*", F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2"), F.col("p.edges").cast("long").alias("offset"))
    known = table.read().select(*PIECE_ID).join(links, PIECE_ID, "left")
    ranks = Table(known.select(*PIECE_ID, F.coalesce("p1", "s1").alias("p1"), F.coalesce("p2", "s2").alias("p2"), F.coalesce("offset", F.lit(0)).alias("offset"), F.col("p1").isNull().alias("done")), "ranks")
    table.drop()
    for _ in range(ranks.read().count().bit_length() + 1):
        if ranks.read().where("not done").isEmpty():
            break
        now = ranks.read()
        back = now.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("offset").alias("more"), F.col("done").alias("end"))
        longer = now.where("not done").join(back, PATH).select(*PIECE_ID, F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("offset") + F.col("more")).alias("offset"), F.col("end").alias("done"))
        following = Table(now.where("done").unionByName(longer), "ranks")
        ranks.drop()
        ranks = following
    own = lambda name, other: F.when(F.col("done"), F.col(name)).otherwise(other).alias(name)
    return ranks.read().select(*PIECE_ID, own("p1", F.col("s1")), own("p2", F.col("s2")), own("offset", F.lit(0)))


def repeated_pieces(docs: DataFrame, k: int = K, short: int = SHORT) -> DataFrame:
    """Occurrences of repeated pieces by source coordinates (the row's key, first word, edges), with their path and offset.

    ``docs`` is keyed and has a text. No repeated edge is missing and none is
    wrong; pieces of one document may overlap by words but not by edges.
    """
    texts = small_batches(docs).select(*KEY, "text").where("text is not null")
    longs, ids = "_file long, _row long, begin long", "u long, v long, s1 long, s2 long"
    stored = Table(texts.mapInArrow(_piece_rows(k, short), f"{longs}, edges int, mini long, {ids}"), "pieces")
    twice = stored.read().groupBy("mini").agg(F.count("*").alias("n"), (F.min("s1") != F.max("s1")).alias("branches")).where("n > 1").drop("n")
    twice = Table(twice, "twice").read()  # written: nothing but a shuffle below the join, so that a minimizer of very many rows can be split
    met = Table(stored.read().join(twice, "mini").drop("mini"), "met")
    stored.drop()
    same = met.read().groupBy(*PIECE_ID).agg(F.count("*").alias("n"), F.max("branches").alias("branches"), F.min(F.struct(*KEY, "begin", "edges")).alias("one"), F.first("u").alias("u"), F.first("v").alias("v"))
    distinct = Table(same, "distinct")
    unfold = distinct.read().where("branches").select("one.*", (F.col("n") == 1).alias("alone"))
    unfold = unfold.groupBy(*KEY).agg(F.collect_list(F.struct("begin", "edges", "alone")).alias("wanted"))  # of one document each
    edges = Table(texts.join(unfold, KEY).mapInArrow(_edge_rows(k), f"{longs}, alone boolean, {ids}"), "edges")
    shared = Table(edges.read().groupBy(*PIECE_ID).agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.first("u").alias("u"), F.first("v").alias("v")).where("n > 1 and alone"), "shared")
    whole = distinct.read().where("n > 1").select(*PIECE_ID, "u", "v", F.col("one.edges").alias("edges"))
    ranks = Table(compacted(whole.unionByName(shared.read().select(*PIECE_ID, "u", "v", F.lit(1).alias("edges")))), "paths").read()
    occurrences = met.read().select(*KEY, "begin", "edges", *PIECE_ID).unionByName(edges.read().where("alone").select(*KEY, "begin", F.lit(1).alias("edges"), *PIECE_ID))
    return occurrences.join(ranks, PIECE_ID).select(*KEY, "begin", F.col("edges").cast("long").alias("edges"), *PATH, "offset")


def spans(docs: DataFrame, k: int = K, short: int = SHORT) -> DataFrame:
    """Per row of keyed ``docs`` with repeated text: its key and ``spans``, the (begin, edges, path, offset) of its longest runs along one path each."""
    rows = repeated_pieces(docs, k, short).repartition(*KEY)  # of one document each, as are the windows
    line = Window.partitionBy(*KEY, *PATH, F.col("begin") - F.col("offset")).orderBy("begin")
    after = F.coalesce(F.lag(F.col("begin") + F.col("edges")).over(line), F.lit(-1))
    rows = rows.withColumn("run", F.sum((F.col("begin") != after).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*KEY, *PATH, (F.col("begin") - F.col("offset")).alias("line"), "run").agg(F.min("begin").alias("begin"), F.sum("edges").alias("edges"), F.min("offset").alias("offset"))
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("begin", "edges", "p1", "p2", "offset")).alias("spans"))


def repeated_spans(docs: DataFrame, k: int = K, short: int = SHORT) -> DataFrame:
    """For ``docs`` (doc_id, text): a row for each span of repeated text along a path: doc_id, first word, words, and path and offset, by which equal spans meet."""
    rows = keyed(docs.select("doc_id", "text"))
    each = rows.select(*KEY, "doc_id").join(spans(rows, k, short), KEY).select("doc_id", F.explode("spans").alias("s"))
    return each.select("doc_id", F.col("s.begin").alias("first_word"), (F.col("s.edges") + k - 1).alias("n_words"), "s.p1", "s.p2", F.col("s.offset").alias("offset"))


def _kept(k: int, doc_id: str):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out, texts = [], []
            for text, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                if found:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, [s["begin"] for s in found], 1)
                    np.add.at(delta, [s["begin"] + s["edges"] + k - 1 for s in found], -1)
                    covered = np.cumsum(delta)[:-1] > 0
                    kept = [words[i] for i in np.flatnonzero(~covered)]
                else:
                    kept = words
                texts.append(b" ".join(kept))
                out.append((len(words), len(words) - len(kept)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows, f"doc_id {doc_id}, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, k: int = K, short: int = SHORT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and ``kept``, the words that no repeated edge covers, joined by a space.

    A null, empty or shorter text keeps all it has; copies of a row are
    occurrences like any others and lose every word that an edge covers; other
    columns are ignored; an empty table gives no rows. Texts are whole, however
    long: pieces of a long one overlap by k - 1 words.
    """
    docs, mark = keyed(docs.select("doc_id", "text")), len(Table.live)
    found = Table(spans(docs, k, short).select(*KEY, F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["edges"].alias("edges"))).alias("spans")), "spans")
    drop_since(mark, keep=found)
    rows = docs.select(*KEY, "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found.read(), KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(*_kept(k, dict(docs.dtypes)["doc_id"]))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
