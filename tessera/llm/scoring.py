"""Operator 10: language-model scores by masked pseudo-likelihood.

A small bidirectional window network predicts every token from the tokens on
both of its sides; the sum of the log-probabilities scores a document. The
vocabulary and the counts inside its classes come from every word of the
corpus, and both grow with it. The network is trained in numpy on every
document: each task takes steps on its share of the input as it streams by, and
the tasks' weights are averaged after each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Table, small_batches
from tessera.llm.hashing import mixed, word_hashes

#: Production parameters. Tokens of a small corpus: so many frequent words, classes of the other words by hash, and one that stands beyond a text's
#: ends. Further frequent words of a larger corpus follow them, see :func:`sizes`.
FREQUENT, CLASSES = 127, 64
SIZE = FREQUENT + CLASSES + 1
#: Neighbours on each side, hidden units, windows of a step at most and at least, step length.
SIDE, HIDDEN, BATCH, LEAST_BATCH, STEP = 2, 16, 2048, 64, 0.5
#: Every document trains in each round. A corpus of fewer words than ENOUGH is gone through several times, ROUNDS at most.
ENOUGH, ROUNDS = 8_000_000, 8
#: Words whose counts a task adds up before it passes them on; words whose windows are held at a time; tables that sum the tasks' weights.
COUNTED, HELD, SUMS = 4_000_000, 1 << 19, 8
#: Cells, at least, of the table of word counts that shares out a class among its words.
CELLS = 1 << 16
#: Units of a weight when weights are summed as whole numbers.
SCALE = 1 << 20


def sizes(n_words: int) -> tuple[int, int]:
    """Frequent words and cells for a corpus of so many words: they grow with its fourth and its square root."""
    return max(FREQUENT, int(2 * n_words**0.25)), max(CELLS, 1 << math.ceil(math.log2(8 * math.sqrt(max(1, n_words)))))


class Vocabulary:
    """Words to tokens, and the log-probability of a word inside its token."""

    def __init__(self, frequent: list[int], cells: np.ndarray):
        """``frequent``: hashes of the frequent words, most frequent first; ``cells``: counts of the other words by class and hash."""
        words = np.array(frequent, np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.cells, self.n_words = words[order], len(cells), int(cells.sum())
        self.order = np.where(order < FREQUENT, order, order + SIZE - FREQUENT)
        self.size = SIZE + max(0, len(words) - FREQUENT)
        smooth = cells.astype(np.float64) + 1
        self.inside = np.log(smooth / smooth.reshape(CLASSES, -1).sum(1).repeat(len(cells) // CLASSES)).astype(np.float32)

    @staticmethod
    def cell(hashes: np.ndarray, cells: int = CELLS) -> np.ndarray:
        return (mixed(hashes, 31) % np.uint64(cells)).astype(np.int64)

    def tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.cell(hashes, self.cells)
        ids, inside = FREQUENT + cell // (self.cells // CLASSES), self.inside[cell]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            ids, inside = np.where(known, self.order[at], ids), np.where(known, np.float32(0), inside)
        return ids, inside


class Network:
    """Predicts a token from SIDE tokens on each side: summed first-layer rows, tanh, softmax over all tokens."""

    def __init__(self, weights: list[np.ndarray] | None = None, size: int = SIZE):
        if weights is None:
            rng = np.random.default_rng(10)
            weights = [rng.normal(0, 0.1, (2 * SIDE, size, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, (HIDDEN, size)).astype(np.float32), np.zeros(size, np.float32)]
        self.first, self.first_bias, self.second, self.second_bias = weights

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.first, self.first_bias, self.second, self.second_bias]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.first[0], around[:, 0], axis=0)
        for j in range(1, 2 * SIDE):
            h += np.take(self.first[j], around[:, j], axis=0)
        h += self.first_bias
        return np.tanh(h, out=h)

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token (n) given those around it (n, 2 * SIDE)."""
        out = np.empty(len(token), np.float32)
        for s in range(0, len(token), 8192):
            z = self.hidden(around[s : s + 8192]) @ self.second
            z += self.second_bias
            z -= z.max(1, keepdims=True)
            own = z[np.arange(len(z)), token[s : s + 8192]]
            out[s : s + 8192] = own - np.log(np.exp(z, out=z).sum(1))
        return out

    def step(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        n, h = len(token), self.hidden(around)
        p = h @ self.second
        p += self.second_bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True) * n
        p[np.arange(n), token] -= np.float32(1 / n)
        back = p @ self.second.T
        back *= 1 - h * h
        self.second -= rate * (h.T @ p)
        self.second_bias -= rate * p.sum(0)
        self.first_bias -= rate * back.sum(0)
        flat, places = back.ravel(), np.arange(HIDDEN)
        for j in range(2 * SIDE):
            at = around[:, j, None] * HIDDEN + places
            self.first[j] -= (rate * 8 * np.bincount(at.ravel(), flat, self.first[j].size)).reshape(-1, HIDDEN).astype(np.float32)


def windows(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The tokens around each token of a group of texts; beyond a text's ends stands the last token."""
    n = len(ids)
    text = np.searchsorted(firsts, np.arange(n), "right") - 1
    low, high = firsts[text], firsts[text + 1]
    around = np.empty((n, 2 * SIDE), np.int64)
    for j, shift in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        at = np.arange(n) + shift
        inside = (at >= low) & (at < high)
        around[:, j] = np.where(inside, ids[np.clip(at, 0, n - 1)], SIZE - 1)
    return around


def pieces(ids: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The windows of a group of texts, at most HELD at a time, each piece with its first token's index."""
    for s in range(0, len(ids), HELD):  # bounded memory for a long text
        low, high = max(0, s - SIDE), min(len(ids), s + HELD + SIDE)
        yield s, windows(ids[low:high], np.clip(firsts - low, 0, high - low))[s - low :][:HELD]


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def counted(groups: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(groups), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    held: list[np.ndarray] = []
    for b in batches:
        held += [h for _, _, h, _ in word_hashes(b.column("text").cast(pa.binary()).to_pylist(), lower=True)]
        if sum(map(len, held)) >= COUNTED:
            yield counted(held)
            held = []
    if held:
        yield counted(held)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From the counts of all words of ``docs``; the driver gets the frequent words and one sum a cell, see :func:`sizes`."""
    counts = Table(small_batches(docs).select("text").where("text is not null").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_words = counts.read().agg(F.sum("n")).first()[0] or 0
    frequent, n_cells = sizes(n_words)
    top = [r["word"] for r in counts.read().orderBy(F.desc("n"), "word").limit(frequent).collect()]
    others = counts.read().where(~F.col("word").isin(top)) if top else counts.read()

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(n_cells, np.int64)
        for b in batches:
            np.add.at(table, Vocabulary.cell(b.column("word").to_numpy().view(np.uint64), n_cells), b.column("n").to_numpy())
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["cell", "n"])

    cells = np.zeros(n_cells, np.int64)
    found = others.mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts.drop()
    made = Vocabulary(top, cells)
    made.n_words = n_words
    return made


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int | None = None, fraction: int = 1) -> Network:
    """The network after ``rounds`` rounds over all texts, or over one in ``fraction`` of them if asked for, chosen by their hash.

    Each task of the scan trains on its own texts, so tasks grow with the
    input; their weights are averaged, each by its number of words, in whole
    numbers that add up the same in any order. SUMS rows reach the driver.
    """
    texts = small_batches(docs).select("text").where("text is not null")
    if fraction > 1:
        texts = texts.where(f"pmod(xxhash64(text), {int(fraction)}) = 0")
    network = Network(size=vocabulary.size)
    for turn in range(rounds or max(1, min(ROUNDS, ENOUGH // max(1, vocabulary.n_words)))):
        start, rate = network.weights, STEP / (1 + turn)

        def steps(batches: Iterator, start=start, rate=rate) -> Iterator:
            import pyarrow as pa

            own, seen, rng = Network([w.copy() for w in start]), 0, np.random.default_rng(11)
            for b in batches:
                for _, _, hashes, firsts in word_hashes(b.column("text").cast(pa.binary()).to_pylist(), lower=True):
                    ids, _ = vocabulary.tokens(hashes)
                    size = max(LEAST_BATCH, min(BATCH, len(ids) // 16))
                    for first, around in pieces(ids, firsts):
                        order = rng.permutation(len(around))
                        for s in range(0, len(order), size):
                            own.step(around[order[s : s + size]], ids[first + order[s : s + size]], rate)
                    seen += len(ids)
            if seen:
                flat = np.rint(np.concatenate([w.ravel() for w in own.weights]).astype(np.float64) * seen * SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["n", "weights"])

        parts = texts.mapInArrow(steps, "n long, weights binary").repartition(SUMS).mapInArrow(_summed, "n long, weights binary").collect()
        if parts:
            flat = (sum(np.frombuffer(p["weights"], np.int64) for p in parts) / (SCALE * sum(p["n"] for p in parts))).astype(np.float32)
            cuts = np.cumsum([w.size for w in start])[:-1]
            network = Network([x.reshape(w.shape).copy() for x, w in zip(np.split(flat, cuts), start, strict=True)])
    return network


def _summed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    n, total = 0, None
    for b in batches:
        for k, w in zip(b.column("n").to_pylist(), b.column("weights").to_pylist(), strict=True):
            flat = np.frombuffer(w, np.int64)
            n, total = n + k, flat.copy() if total is None else total + flat
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def score(docs: DataFrame, vocabulary_: Vocabulary | None = None, network: Network | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood and mean (null without a token).

    Without a vocabulary and a network both come from ``docs`` itself. A null,
    empty or blank text has no tokens and a likelihood of 0 in logarithm;
    repeated rows score each; other columns are ignored; an empty table gives
    no rows. Long texts are scored whole.
    """
    words = vocabulary_ or vocabulary(docs)
    model = network or train(docs, words)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, last, hashes, firsts in word_hashes(b.column("text").cast(pa.binary()).to_pylist(), lower=True):
                ids, inside = words.tokens(hashes)
                logs = np.zeros(len(ids) + 1)
                for s, around in pieces(ids, firsts):
                    logs[1 + s : 1 + s + len(around)] = model.log_probability(around, ids[s : s + len(around)]) + inside[s : s + len(around)]
                sums, n = np.cumsum(logs), np.diff(firsts)
                total = sums[firsts[1:]] - sums[firsts[:-1]]
                mean = pa.array([t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean"])

    return small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, log_likelihood double, mean double")
