"""Operator 7: n-gram Jaccard join by token-combination prefixes (after Wang et al., pkwise).

A set's tokens, its word shingles, stand in one global order, the rarest first.
A set of n tokens that lacks at most m = n - ceil(t * n) of a partner's has this
property: take a prefix and deal its tokens into classes, a class of rare
tokens whose members count one by one, and classes of frequent tokens whose
members count from the second on. Once the prefix counts m + 1, every partner
shares a rare token or a pair of frequent tokens of one class with it, both
inside its own such prefix. So rare tokens are indexed alone and frequent ones
in pairs only, tokens that one set has are not indexed at all though they
count, and no link is missed. The number of classes depends on the sets' size;
sizes fall into strata so that partners share one.

Counting every token of every set would shuffle more than the texts. A first
pass therefore takes each set's prefix in the order of the tokens' hashes, a
tenth of the set longer than the tokens that may be missing: a set with fewer
than a tenth of shared tokens in it has no partner. Only the sets that are left
are counted whole, and of these only the ones that share all but m tokens with
others are indexed.

Each signature carries how many tokens the set can still share when it is the
first one in common: the tokens from its place on, and one of each class before
it. Where that is too few for any partner the signature is left out; for the
others it bounds the partner's size, so that sets of one large group which
differ too much are never paired. What shares a signature is linked by :func:`tessera.llm.common.link_buckets`.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEY, Table, aside, drop_since, keyed, link_buckets, small_batches, strata, verified
from tessera.llm.hashing import chained, mixed, word_hashes

#: Production parameters: words of a shingle, least similarity in per cent, and in how many sets a token is frequent.
SHINGLE, PERCENT, FREQUENT = 5, 80, 32


def most_missing(n, percent: int):
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - -(-n * percent // 100)


def prefix_length(n, percent: int):
    return np.minimum(n, most_missing(n, percent) + 1 + n // 10)


def least_shared(n: str, percent: int) -> str:
    """SQL: tokens that a set of any partner's prefix must have in common with that partner's prefix: what the smaller prefix is longer than its set may lack, plus one."""
    return f"(({n} * {percent} + 99) div 100) div 10 + 1"


def token_sets(texts: list[bytes], shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts: the first's index, all their sets one after another, each sorted, and where each begins (one more at the end)."""
    for first, last, hashes, firsts in word_hashes(texts, lower=True):
        counts, starts = np.diff(firsts), np.arange(max(0, len(hashes) - shingle + 1))
        text = np.searchsorted(firsts, starts, "right") - 1
        whole = starts + shingle <= firsts[text + 1]
        values, text = [chained(hashes, starts[whole], shingle, 6)], [text[whole]]
        for n in range(1, shingle):
            text.append(np.flatnonzero(counts == n))
            values.append(chained(hashes, firsts[text[-1]], n, 6))
        values, text = np.concatenate(values), np.concatenate(text)
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (text[1:] != text[:-1])] if len(values) else np.zeros(0, bool)
        values, text = values[new], text[new]
        yield first, values, np.searchsorted(text, np.arange(last - first + 1))


def _set_rows(shingle: int, percent: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, values, begins in token_sets(b.column("text").cast(pa.binary()).to_pylist(), shingle):
                n, many = np.diff(begins), len(begins) - 1
                d1, d2 = (np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(values, salt), dtype=np.uint64)] for salt in (11, 12))
                d1, d2 = (d[begins[1:]] - d[begins[:-1]] for d in (d1, d2))
                sizes = prefix_length(n, percent)
                at = np.repeat(begins[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values[at].view(np.int64)))
                part = b.slice(first, many)
                yield pa.RecordBatch.from_arrays([part.column(KEY[0]), part.column(KEY[1]), part.column("doc_id"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), prefix], names=[*KEY, "doc_id", "n", "d1", "d2", "prefix"])

    return rows


def _signature_rows(percent: int, frequent: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sigs, nodes, sizes, common = [], [], [], []
            tokens = b.column("tokens")
            begins, flat = tokens.offsets.to_numpy(), tokens.values
            all_df, all_h = flat.field("df").to_numpy(), flat.field("h").to_numpy().view(np.uint64)
            for i, (node, n) in enumerate(zip(b.column("node").to_pylist(), b.column("n").to_pylist(), strict=True)):
                df, h = all_df[begins[i] : begins[i + 1]], all_h[begins[i] : begins[i + 1]]
                order = np.lexsort((h, df))
                df, h = df[order], h[order]
                alone, needed, often = n - len(h), most_missing(n, percent) + 1, df > frequent
                least = strata(percent, n)
                own = bisect.bisect_right(least, n) - 1
                made: list[tuple[np.ndarray, np.ndarray]] = []
                for scheme in (own, own + 1):
                    classes = least[scheme - 1] // 10 if scheme else 0
                    counts, single = np.ones(len(h), np.int64), ~often if classes else np.ones(len(h), bool)
                    if classes and often.any():
                        group = mixed(h, 20) % np.uint64(classes)
                        _, begin = np.unique(group[often], return_index=True)
                        counts[np.flatnonzero(often)[begin]] = 0
                    stop = int(np.searchsorted(np.cumsum(counts), needed - alone)) + 1
                    # no earlier token is common if this one makes the first common signature, but for one of each class that came before
                    most = np.arange(len(h), 0, -1) + np.r_[0, np.cumsum(1 - counts)[:-1]]
                    inside = np.arange(len(h)) < stop
                    made.append((mixed(h[inside & single], 21), most[inside & single]))
                    chosen = inside & ~single
                    if chosen.any():
                        x, g, q = mixed(h[chosen], 22 + scheme), group[chosen], most[chosen]
                        by_group = np.lexsort((x, g))
                        x, g, q = x[by_group], g[by_group], q[by_group]
                        step = 1
                        while step < len(g):
                            pairs = np.flatnonzero(g[step:] == g[:-step])
                            if not len(pairs):
                                break
                            made.append((mixed(x[pairs] * np.uint64(3) + x[pairs + step], scheme), np.minimum(q[pairs], q[pairs + step])))
                            step += 1
                own_sigs, q = (np.concatenate(x) for x in zip(*made, strict=True))
                reaches = q * (100 + percent) // percent - n >= -(-n * percent // 100)
                own_sigs, q = own_sigs[reaches], q[reaches]
                order = np.lexsort((-q, own_sigs))
                own_sigs, q = own_sigs[order], q[order]
                new = np.r_[True, own_sigs[1:] != own_sigs[:-1]] if len(q) else np.zeros(0, bool)
                sigs.append(own_sigs[new].view(np.int64))
                common.append(q[new])
                nodes.append(np.full(len(sigs[-1]), node))
                sizes.append(np.full(len(sigs[-1]), n))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, nodes, sizes, common)], names=["sig", "node", "n", "q"])

    return rows


def _node_sets(shingle: int):
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for first, values, begins in token_sets(b.column("text").cast(pa.binary()).to_pylist(), shingle):
                sets = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))
                part = b.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), sets], names=["node", "n", "tokens"])

    return rows


def linked_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, has_keys: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its key, doc_id, n_shingles, ``group`` (a number for its component; null for an empty set) and component_id.

    Equal sets are one node. A null, empty or blank text has the empty set and
    links with nothing: its component is its own doc_id. A row without doc_id
    takes its component's smallest. Repeated rows are copies like any others;
    other columns are ignored, whatever their names; an empty table gives no
    rows. ``has_keys``: ``docs`` comes from :func:`keyed`.
    """
    mark = len(Table.live)
    docs = small_batches(docs if has_keys else keyed(docs.select("doc_id", "text")))
    id_type = dict(docs.dtypes)["doc_id"]
    texts = docs.select(*KEY, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = Table(texts.mapInArrow(_set_rows(shingle, percent), f"{KEY[0]} long, {KEY[1]} long, doc_id {id_type}, n long, d1 long, d2 long, prefix array<long>"), "sets")
    by_set = first.read().where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct(*KEY)).alias("one"), F.first("prefix").alias("prefix"))
    nodes = Table(by_set.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = Table(first.read().drop("prefix"), "members")
    first.drop()

    tokens = nodes.read().select("node", "n", F.explode("prefix").alias("h"))
    shared = Table(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"), "tokens")
    met = tokens.join(shared.read(), "h").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("shared")).where(f"shared >= {least_shared('n', percent)}")
    left = Table(met.select("node", "n"), "left")
    known = Table(nodes.read().drop("prefix"), "known")
    nodes.drop()

    wanted = left.read().join(known.read().select("node", "one.*"), "node")
    sets = Table(docs.select(*KEY, "text").join(wanted, KEY).select("node", "n", "text").mapInArrow(_node_sets(shingle), "node long, n long, tokens array<long>"), "whole-sets")
    tokens = sets.read().select("node", "n", F.explode("tokens").alias("h"))
    counts = Table(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    by_node = tokens.join(counts.read(), "h").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "h")).alias("tokens"))  # of one set each
    by_node = by_node.where(f"size(tokens) >= (n * {int(percent)} + 99) div 100")
    sigs = Table(by_node.mapInArrow(_signature_rows(percent, frequent), "sig long, node long, n long, q long"), "signatures")
    labels = link_buckets(sigs.read(), verified(sets.read(), percent), percent)
    named = known.read().select("n", "d1", "d2", "node").join(labels, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("group"))
    grouped = Table(members.read().join(named, ["n", "d1", "d2"], "left").select(*KEY, "doc_id", F.col("n").alias("n_shingles"), "group"), "grouped")
    drop_since(mark, keep=grouped)
    rows = grouped.read()
    least = Table(rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "least").read()  # written, so that a group of very many rows can be split
    return rows.join(least, "group", "left").select(*KEY, "doc_id", "n_shingles", "group", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id, and every row that has no shingle.

    Repeated rows and equal doc_ids are copies: one row stays, the first as
    stored. All columns of ``docs`` come back as they are, whatever their names.
    """
    inner, back = aside(docs, ["doc_id", "text"])
    rows = keyed(inner)
    found = linked_sets(rows, has_keys=True, **options)
    apart = found.where("group is null").select(*KEY)
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("one")).select(*[F.col(f"one.{k}") for k in KEY])
    return back(rows.join(apart.unionByName(first), KEY, "left_semi"))
