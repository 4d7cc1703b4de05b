"""What the operators of this subpackage share: words, tables in the shared
folder, row keys, distributed prefix sums and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What parts words, and a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where none is named and no executor is elsewhere, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        path = kept.get() if kept.isDefined() else f"file://{tempfile.gettempdir()}/checkpoints"
    return path.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of stages that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Parameter: rows of a batch of texts that a Python worker gets at a time.
BATCH_ROWS = 1500


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are set to at most BATCH_ROWS rows: what a worker holds is bounded by that many texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


class Table:
    """A written DataFrame: lineage ends here, and a lost executor re-reads files."""

    #: Tables that aren't dropped yet, in the order they were made.
    live: ClassVar[list[Table]] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self._kept()

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Table:
        """A folder that goes like a table's when nothing reads it any more."""
        made = cls.__new__(cls)
        made.spark, made.path = spark, path
        made._kept()
        return made

    def _kept(self) -> None:
        self.conf, self.jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        Table.live.append(self)
        free_shuffles(self.spark)

    def read(self, keys: bool = False) -> DataFrame:
        """Its rows; with ``keys`` also the two columns of :func:`keyed`."""
        df = self.spark.read.schema(self.schema).parquet(self.path)
        return keyed(df) if keys else df

    def drop(self) -> None:
        if self not in Table.live:
            return
        Table.live.remove(self)
        path = self.jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.conf).delete(path, True)


@atexit.register
def _drop_at_exit() -> None:
    """What a result was read from goes with the session that made it; a lost gateway leaves it to the folder's owner."""
    with contextlib.suppress(Exception):
        drop_since(0)


def drop_since(mark: int, keep: Table | None = None) -> None:
    """Drops the tables made since there were ``mark``, but for the one that holds the result; drop_since(0) drops all, when no result is read any more."""
    for table in Table.live[mark:]:
        if table is not keep:
            table.drop()


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return Table(df, name).read()


#: The names of a row's key: a hash of its file's path, and its index in the file.
KEY = ["_file", "_row"]


def stored(df: DataFrame) -> bool:
    """Is each row of ``df`` one stored row: a Parquet scan under nothing but projections and filters? Joins, unions and explode give a row's key to several."""
    plan = df._jdf.queryExecution().analyzed()
    if "_metadata#" not in plan.metadataOutput().mkString(","):
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.toString().rstrip().endswith(" parquet")


def keyed(df: DataFrame) -> DataFrame:
    """Adds a key that is unique to a row, however the scan is split; what is not a bare Parquet scan (:func:`stored`) is written first."""
    if not stored(df):
        return Table(df, "rows").read(keys=True)
    return df.select("*", F.xxhash64("_metadata.file_path").alias(KEY[0]), F.col("_metadata.row_index").alias(KEY[1]))


#: Parameter: bits of a sieve, whatever the number of keys, in blocks of the 4096 bytes that Spark's bitmaps have.
SIEVE_BITS = 2**25
BLOCK_BITS = 2**15


def sieved(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without nearly all rows whose columns ``names`` are not in ``keys``; no row that has a key there is lost.

    For a join to come, which then moves few rows that it drops. Keys are marked
    in SIEVE_BITS bits, which are broadcast: 4 MB of bits, however many keys there are.
    With more than a tenth as many keys as bits, more rows pass that have none.
    """
    bit = F.expr(f"pmod(xxhash64({', '.join(names)}), {SIEVE_BITS})")
    marked = keys.select(bit.alias("_bit")).withColumn("_block", F.expr(f"_bit div {BLOCK_BITS}")).repartition("_block")  # keys move, not their bitmaps
    blocks = marked.groupBy("_block").agg(F.expr(f"bitmap_construct_agg(_bit % {BLOCK_BITS})").alias("_marks"))
    byte = f"cast(conv(hex(substring(_marks, cast(_bit % {BLOCK_BITS} div 8 + 1 as int), 1)), 16, 10) as int)"
    placed = df.withColumn("_bit", bit).join(F.broadcast(blocks), F.expr(f"_bit div {BLOCK_BITS} = _block"))
    return placed.where(f"shiftright({byte}, cast(_bit % 8 as int)) & 1 = 1").select(*df.columns)


def aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the columns that an operator doesn't use under names of their own, and a function that gives them back, with further columns."""
    names = {c: c if c in used else f"_x{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)

    return inner, back


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str = "before", **more: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same group that come before, in ``order``; ``more`` gives further sums, value=out.

    The rows are dealt by ranges of (group, order), so that a group of any size
    spreads over many tasks; each range sums its own rows and only one row for
    each range and group meets in the window that carries the sums across
    ranges. The ranges are written first: they never move afterwards.
    """
    outs = {value: out} | more
    placed = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in outs])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_k_{c}") for c in [*group, "_part"]], *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_start_{v}") for v in outs])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = F.lit(True)
    for c in [*group, "_part"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    local = placed.withColumns({f"_local_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in outs})
    summed = local.join(starts, on).withColumns({o: F.col(f"_start_{v}") + F.col(f"_local_{v}") for v, o in outs.items()})
    return summed.drop("_part", *[f"{c}_{v}" for c in ("_start", "_local") for v in outs], *[f"_k_{c}" for c in [*group, "_part"]])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, component: the smallest node that is reachable).

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step joins each node's neighbours to the smallest of them, which takes a
    number of rounds logarithmic in the diameter. A node of very many
    neighbours is only aggregated, never gathered.
    """
    table = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(table.read()):
        e = table.read()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = Table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)  # written: a join to a mere shuffle can be split
        large = both.join(least.read(), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = Table(large, name)
        e = mid.read()
        least = Table(e.groupBy("a").agg(F.min("b").alias("m")), name)
        small = e.join(least.read(), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        table.drop()
        table = Table(small, name)
        mid.drop()
    return table.read().select(F.col("a").alias("node"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Does every edge lead from a node, which has no other, to a centre, which has none?"""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def strata(percent: int, most: int) -> list[int]:
    """Least sizes of the strata up to ``most``: sets of likeness ``percent`` or more are in the same or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def verified(sets: DataFrame, percent: int) -> Callable[[DataFrame], DataFrame]:
    """A check of pairs (a, b) by the whole sets (node, tokens: array<long>): linked if 100 * intersection >= percent * union."""

    def verify(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", (100 * both >= percent * (F.size("x") + F.size("y") - both)).alias("linked"))

    return verify


def reach(n: str, overlap: str, percent: int) -> tuple[Column, Column]:
    """Least and most tokens of a partner: its size must fit a set's ``n``, and both sizes may ask for ``overlap`` common tokens at most."""
    most = F.least(F.expr(f"{n} * 100 div {percent}"), F.expr(f"{overlap} * {100 + percent} div {percent} - {n}"))
    return F.expr(f"({n} * {percent} + 99) div 100"), most


def link_buckets(index: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Components (node, component) of sets that share a bucket and pass ``verify``.

    ``index`` has (sig, node, n, q): n is the set's size, q how many tokens it
    can share with a set whose first common bucket is this one. ``verify``
    takes distinct pairs (a, b) and adds ``linked``.

    Sizes and q give each row the sizes of partners it can have here (see
    :func:`reach`); rows that no other row of their bucket can meet are left
    out before anything is paired. A bucket's members are verified against two
    pivots, first the one whose q covers most of it, so a large group of copies
    costs a star and no square. Where a bucket still holds more than one
    component, its rows meet the other components as a whole, by the sizes that
    these offer and accept there, and only then their members.
    """
    low, high = reach("n", "q", percent)
    rows = Table(index.select("sig", "node", "n", low.alias("low"), high.alias("high"), (F.col("q") * 1_000_000).alias("q")).where("low <= high"), "reach")
    sizes = rows.read().groupBy("sig").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("low").alias("lowest"), F.max("high").alias("highest")).where("many > 1")
    met = rows.read().join(Table(sizes, "sizes").read(), "sig").where("least <= high and most >= low and lowest <= n and highest >= n")
    index = Table(met.select("sig", "node", "n", "low", "high", F.expr("q div n").alias("share")), "index").read()
    rows.drop()

    def labelled(labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return index.withColumn("c", F.col("node"))
        return index.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")

    fits = F.expr("o.n between r.low and r.high and r.n between o.low and o.high")
    labels, tried = None, None
    for step in ("centre", "mixed", "rest"):
        rows = labelled(labels)
        order = F.xxhash64("sig", "node") if step == "mixed" else F.col("share")
        pivot = F.max(F.struct(order.alias("o"), (-F.col("node")).alias("first"), "node", "n", "low", "high", "c"))
        pivots = Table(rows.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pivot.alias("p")).where("lo < hi").select("sig", "p.node", "p.n", "p.low", "p.high", "p.c"), "pivots")
        if step == "rest":
            pairs = _across(rows, pivots.read().select("sig"), fits)
        else:
            pairs = rows.alias("r").join(pivots.read().alias("o"), (F.col("r.sig") == F.col("o.sig")) & (F.col("r.c") != F.col("o.c")) & fits)
        pairs = pairs.select(F.greatest("r.node", "o.node").alias("a"), F.least("r.node", "o.node").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        checked = Table(verify(pairs), "pairs").read()
        tried = checked if tried is None else tried.unionByName(checked)
        labels = components(tried.where("linked").select("a", "b"))
    return labels


def _across(rows: DataFrame, open_sigs: DataFrame, fits: Column) -> DataFrame:
    """Pairs of rows r and o in different components that share an open bucket and fit.

    A row first meets a component by the sizes that its members in the bucket
    have and accept together, one row for each component there; what no member
    can fit ends here, and only what is left meets the members.
    """
    open_ = Table(rows.join(open_sigs, "sig", "left_semi"), "open")
    there = open_.read().groupBy("sig", "c").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    there = Table(there, "there")
    own = open_.read().join(there.read().select("sig", "c", F.col("many").alias("own")), ["sig", "c"]).alias("r")
    other = F.expr("o.least <= r.high and o.most >= r.low and o.lowest <= r.n and o.highest >= r.n and (r.own < o.many or (r.own = o.many and r.c < o.c))")
    meets = own.join(there.read().alias("o"), (F.col("r.sig") == F.col("o.sig")) & other).select("r.*", F.col("o.c").alias("d"))
    meets = Table(meets, "meets").read().alias("r")
    return meets.join(open_.read().alias("o"), (F.col("r.sig") == F.col("o.sig")) & (F.col("r.d") == F.col("o.c")) & fits)
