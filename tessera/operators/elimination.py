"""Near-duplicate elimination in order, for groups of any size.

The rule is a fold: each row still kept meets the later kept ones that are near
it; of such a pair the lower score goes, of equal scores the later row, and a
row that goes meets no more. Here the fold runs as Spark jobs:

* A run of neighbours with one vector leaves only its first row of the largest
  score: nothing stands between them that could end a row's turn.
* Groups are gone through by prefixes that double, and only rows that are still
  kept are compared with later ones. A class of copies costs about a star.
* Near pairs come from blocks of rows, ordered by their angle to the group's
  first vector; blocks whose angles are too far apart never meet.
* In a round, each row takes its turn whose earlier rivals have all had theirs.
  A group with few pairs left is folded from its pairs in one task.
* Where a group has few different vectors, copies of one that is near no other
  leave their first row of the largest score, at once.
* Groups of a few rows are folded as rows of a table, many in a batch, and take
  no part in the above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import unit
from tessera.sources.tables import numbered, written

#: Parameters: rows of the first prefix, what prefixes grow by, rows of a block, pairs of a group that one task folds, rows of a group that is folded as one row of a table, different vectors of a group whose copies are looked at as classes.
FIRST, GROWTH, BLOCK, FOLD, SMALL, CLASSES = 64, 4, 512, 500_000, 64, 4096


def _first_of_runs(rows: DataFrame) -> DataFrame:
    """(ordinal): the rows of each run of equal neighbours that go at once. A run that crosses a range is taken apart there, which leaves more to the rounds and changes nothing."""
    inside = Window.partitionBy("_range", "g").orderBy("ordinal")
    ranges = rows.where("score is not null and not isnan(score) and u is not null").repartitionByRange("ordinal").withColumn("_range", F.spark_partition_id())
    new = ~((F.lag("u").over(inside) == F.col("u")) & (F.lag("ordinal").over(inside) == F.col("ordinal") - 1))
    runs = ranges.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    runs = written(runs.withColumn("_run", F.sum("_new").over(inside)).select("_range", "g", "_run", "ordinal", "score"), "runs")
    best = runs.groupBy("_range", "g", "_run").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    return runs.join(best, ["_range", "g", "_run"]).where("ordinal <> -_best.o").select("ordinal")


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """At most BLOCK rows of one group in a row of the table, with the least and largest of their angles."""
    ranges = rows.repartitionByRange("g", "angle").withColumn("_range", F.spark_partition_id())
    place = Window.partitionBy("_range", "g", "dims").orderBy("angle")
    ranges = ranges.withColumn("_place", F.row_number().over(place) - 1).withColumn("_block", F.expr(f"_place div {BLOCK}"))
    packed = ranges.groupBy("g", "dims", "_range", "_block").agg(F.collect_list(F.struct("ordinal", "score", "u")).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return written(packed.withColumn("id", F.struct("g", "dims", "_range", "_block")).select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "g", "dims", "low", "high", "rows")]), "blocks")


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    def parts(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = rows.field("score").to_numpy(zero_copy_only=False).astype(float)
        return rows.field("ordinal").to_numpy(), scores, rows.field("u").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    for batch in batches:
        for n in range(batch.num_rows):  # a pair of blocks at a time, as they lie in the batch
            (a, sa, ua), (b, sb, ub) = (parts(batch.column(side)[n].values) for side in ("l_rows", "r_rows"))
            i, j = np.nonzero((ua @ ub.T > threshold) & (a[:, None] < b[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), batch.column("l_g")[n].as_py())), pa.array(a[i]), pa.array(b[j]), pa.array(sb[j] > sa[i])], names=["g", "a", "b", "stop"])


def _edges(early: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b, stop): the pairs of a row of ``early`` and a later one of ``rows`` whose cosine is above ``threshold``; stop: the later one has the larger score."""
    left, right = _blocks(early, "l"), _blocks(rows, "r")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    meet = (F.col("l_g") == F.col("r_g")) & (F.col("l_dims") == F.col("r_dims")) & (F.col("l_low") - F.col("r_high") <= reach) & (F.col("r_low") - F.col("l_high") <= reach)
    ids = left.drop("l_rows").join(right.drop("r_rows"), meet).select("l_id", "r_id")
    pairs = ids.join(left.select("l_id", "l_g", "l_rows"), "l_id").join(right.select("r_id", "r_rows"), "r_id")
    return written(pairs.select("l_g", "l_rows", "r_rows").mapInArrow(lambda batches: _near(batches, threshold), "g long, a long, b long, stop boolean"), "near")


def _fold(pairs: pd.DataFrame) -> pd.DataFrame:
    """The fold over one group's pairs (a, b, stop, kb: when an earlier turn took b): the rows that go."""
    pairs = pairs.sort_values(["a", "b"])
    taken = {b: t for b, t in zip(pairs["b"], pairs["kb"], strict=True) if not pd.isna(t)}
    turn, over = -1, False
    for a, b, stop in zip(pairs["a"], pairs["b"], pairs["stop"], strict=True):
        if a != turn:
            turn, over = a, a in taken
        if over or taken.get(b, math.inf) < a:
            continue
        if stop:
            taken[a], over = a, True
        else:
            taken[b] = a
    return pd.DataFrame({"ordinal": list(taken)}, dtype="int64")


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that are left (with ``kb``, the first turn that took b) and the rows (ordinal) that go in this round.

    A row's turn can be played when no row that could take it is left before it
    and of the later rows with larger scores the first that stands is sure to.
    The first row of all can always play.
    """
    rivals = written(edges.where("not stop").groupBy("b").agg(F.min("a").alias("f")), "rivals")
    stands = F.when(F.col("stop") & F.coalesce(F.col("kb") >= F.col("a"), F.lit(True)), F.struct("b", F.coalesce(F.col("f") >= F.col("a"), F.lit(True)).alias("sure")))
    turns = edges.join(rivals, "b", "left").groupBy("a").agg(F.min(stands).alias("end"))
    turns = turns.join(rivals.select(F.col("b").alias("a")), "a", "left_anti").where("end is null or end.sure").select("a", F.col("end.b").alias("until"))
    turns = written(turns, "turns")
    took = edges.where("not stop").join(turns, "a").where("until is null or b < until").groupBy("b").agg(F.min("a").alias("t"))
    took = written(took, "took")
    left = edges.join(turns.select("a"), "a", "left_anti").join(took.select(F.col("b").alias("a")), "a", "left_anti").join(took, "b", "left")
    gone = took.select(F.col("b").alias("ordinal")).unionByName(turns.where("until is not null").select(F.col("a").alias("ordinal")))
    return written(left.withColumn("kb", F.least("kb", "t")).select("g", "a", "b", "stop", "kb"), "left"), gone


def settled(edges: DataFrame, fold: int = FOLD) -> DataFrame:
    """(ordinal): the rows that go by the near pairs ``edges`` (g, a, b, stop), a before b, in the order of numbers."""
    edges, gone = edges.withColumn("kb", F.lit(None).cast("long")), []
    while True:
        sizes = written(edges.groupBy("g").agg(F.count("*").alias("n")), "sizes")
        small = edges.join(sizes.where(F.col("n") <= fold).select("g"), "g", "left_semi")
        gone.append(small.groupBy("g").applyInPandas(_fold, "ordinal long"))
        large = sizes.where(F.col("n") > fold).select("g")
        if large.isEmpty():
            break
        edges, more = _round(edges.join(large, "g", "left_semi"))
        gone.append(more)
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return written(out.distinct(), "gone")


def _lone_copies(kept: DataFrame, threshold: float) -> DataFrame:
    """(ordinal): the rows that go in classes of equal vectors which are near nothing else.

    In such a class the row whose turn it is takes all until the first with a
    larger score, which ends it: the first of the largest score is left.
    """
    made = kept.groupBy("g", "dims", "angle", "u").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"), F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("best"), F.max(F.col("score").isNull() | F.isnan("score")).alias("odd"))
    made = written(made, "classes")
    few = written(made.groupBy("g").agg(F.count("*").alias("_d"), F.sum("n").alias("_n")).where(f"_d <= {CLASSES} and 2 * _d <= _n").select("g"), "few")
    classes = made.join(few, "g", "left_semi")
    vectors = classes.select("g", "dims", "angle", "u", "ordinal", F.col("best.score").alias("score"))
    near = _edges(vectors, vectors, threshold)
    near = near.select(F.explode(F.array("a", "b")).alias("ordinal")).distinct()
    lone = written(classes.where("n > 1 and not odd").join(near, "ordinal", "left_anti").select("g", "u", F.col("best.o").alias("_o")), "lone")
    return written(kept.select("g", "u", "ordinal").join(lone, ["g", "u"]).where("ordinal <> -_o").select("ordinal"), "gone")


def _stays(u: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """The fold over a small group's rows in order: which are kept."""
    near, kept = u @ u.T > threshold, np.ones(len(u), bool)
    for i in range(len(u)):
        if kept[i]:
            later = np.flatnonzero(near[i, i + 1 :] & kept[i + 1 :]) + i + 1
            higher = np.flatnonzero(scores[later] > scores[i])
            kept[i] = not len(higher)
            kept[later[: higher[0]] if len(higher) else later] = False
    return kept


def _units(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, directions) of ``vectors``, each of ``d`` numbers; those without a direction, or with a null, are left out."""
    flat = vectors.flatten()
    whole = np.flatnonzero(~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(1))
    m = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)[whole]
    with np.errstate(invalid="ignore", divide="ignore"):
        u = m / np.sqrt(np.cumsum(m * m, axis=1)[:, -1:])
    some = np.isfinite(u).all(1) & u.any(1)
    return whole[some], u[some]


def _stay(threshold: float):
    """Of arrays of (score, v), each a group in order: the places that the fold keeps; an array at a time."""

    @F.arrow_udf("array<int>")
    def stay(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in groups:
            out, items = [], batch.flatten()
            ends = np.cumsum([0, *pc.list_value_length(batch).to_pylist()])
            scores, v = items.field("score").to_numpy(zero_copy_only=False).astype(float), items.field("v")
            sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                kept = np.ones(high - low, bool)
                for d in np.unique(sizes[low:high]):  # vectors of different lengths are near nothing of each other
                    if d:
                        at = low + np.flatnonzero(sizes[low:high] == d)
                        some, u = _units(v.take(pa.array(at)), d)
                        kept[at[some] - low] = _stays(u, scores[at[some]], threshold)
                out.append(np.flatnonzero(kept))
            yield pa.array(out, pa.list_(pa.int32()))

    return stay


def _small_groups(rows: DataFrame, grp: str, pos: str, score: str, vector: str, threshold: float) -> DataFrame:
    """The fold over groups that are small: each one array, of which the function is sent scores and vectors only."""
    before = lambda a, b: F.when(a[pos].eqNullSafe(b[pos]), 0).when(a[pos].isNull(), -1).when(b[pos].isNull(), 1).when(a[pos] < b[pos], -1).otherwise(1)
    groups = rows.groupBy(grp).agg(F.array_sort(F.collect_list(F.struct(*rows.columns)), before).alias("_rows"))
    groups = groups.withColumn("_kept", _stay(threshold)(F.transform("_rows", lambda r: F.struct(r[score].cast("double").alias("score"), r[vector].cast("array<double>").alias("v")))))
    return groups.select(F.explode(F.transform("_kept", lambda i: F.get("_rows", i))).alias("_r")).select("_r.*")


def survivors(rows: DataFrame, threshold: float = 0.85, group: str = "query_id", score: str = "sort_score", first: int = FIRST, fold: int = FOLD) -> DataFrame:
    """A9 for groups of any size: the rows of ``rows`` (group, pos, embedding, score, ...) that the fold in the order of ``pos`` keeps.

    ``pos`` is unique in its group; equal ones take any order. Null and zero
    vectors, and vectors of different lengths, are near nothing. A null score
    is larger than none. Null groups are one group; an empty table gives no
    rows; all columns come back, whatever their names.
    """
    names = {c: f"_c{i}" for i, c in enumerate(rows.columns)}
    if threshold > 1 + 1e-9:
        return rows  # no cosine is so large
    inner = written(rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_id")), "rows")
    grp, pos = names[group], names["pos"]
    vector = unit(F.col(names["embedding"]))
    vector = F.when(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), vector)
    sizes = written(inner.groupBy(grp).agg(F.count("*").alias("_n")), "sizes")
    small = (F.col("_n") <= min(SMALL, first)) & (F.col("_n") * (F.col("_n") - 1) <= 2 * fold)
    some = lambda what: inner.join(sizes.where(what).select(F.col(grp).alias("_grp")), F.col(grp).eqNullSafe(F.col("_grp")), "left_semi")
    all_small = sizes.where(~small).isEmpty()
    kept = _small_groups((inner if all_small else some(small)).drop("_id"), grp, pos, names[score], names["embedding"], threshold)
    if not all_small:
        large = some(~small)
        gone = _gone(large.select("_id", grp, pos, F.col(names[score]).cast("double").alias("score"), vector.alias("u")), grp, pos, threshold, first, fold)
        kept = kept.unionByName(large.join(gone, "_id", "left_anti").select(*names.values()))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def _gone(rows: DataFrame, grp: str, pos: str, threshold: float, first: int, fold: int) -> DataFrame:
    """(_id) of the rows (_id, group, place, score, u) that go; what else the rows hold stays where it is."""
    whole = numbered(rows, [grp, pos])
    starts = written(whole.groupBy(grp).agg(F.min("ordinal").alias("g")), "starts").withColumnRenamed(grp, "_grp")
    made = whole.join(starts, F.col(grp).eqNullSafe(F.col("_grp")))
    kept = written(made.select("g", "ordinal", "score", "u"), "vectors")
    gone = []
    if threshold < 1 - 1e-9:
        gone.append(written(_first_of_runs(kept), "gone"))
        kept = kept.join(gone[0], "ordinal", "left_anti")
    pivot = kept.where("u is not null").groupBy("g").agg(F.min_by("u", "ordinal").alias("_p"))
    near = F.expr("aggregate(zip_with(u, _p, (x, y) -> coalesce(x * y, 0D)), 0D, (s, x) -> s + x)")
    kept = kept.where("u is not null").join(pivot, "g").withColumn("dims", F.size("u"))
    kept = kept.withColumn("angle", F.when(F.col("dims") == F.size("_p"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), near)))).otherwise(0.0)).drop("_p")
    kept = written(kept, "kept")
    if threshold < 1 - 1e-9:
        gone.append(_lone_copies(kept, threshold))
        kept = written(kept.join(gone[-1], "ordinal", "left_anti"), "kept")
    place, high = F.col("ordinal") - F.col("g"), first
    low, most = kept.agg(F.min(place), F.max(place)).first()
    while low is not None:
        while high <= low:
            high *= GROWTH
        gone.append(settled(_edges(kept.where(place < high), kept, threshold), fold))
        if high > most:
            break
        kept = written(kept.join(gone[-1], "ordinal", "left_anti").where(place >= high), "kept")
        low, most = kept.agg(F.min(place), F.max(place)).first()  # where all is gone, no further prefix is played
    out = gone[0] if gone else None
    for table in gone[1:]:
        out = out.unionByName(table)
    return whole.join(out, "ordinal", "left_semi").select("_id") if gone else whole.limit(0).select("_id")
