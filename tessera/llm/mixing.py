"""Operator 9: mixing sources to target weights.

Every row gets a hash-random key; the rows of a source are range-sorted by it,
distributed prefix sums of their sizes place each row on its source's line, and
the line is cut at the source's exact budget. A budget beyond the source's size
repeats whole epochs and cuts the last one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import KEY, SPACES, WORD, aside, keyed, prefix_sums

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with each source's target.

    Weights go to the sources in code-point order, null last, and repeat.
    Sharing a budget by weight, and sharing anew what goes beyond ``most``
    times a source's size, ends at one level: target = least(most * size,
    level * weight). The level follows from the sources sorted by the level at
    which they are full. One row for each source takes part, no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1).cast("int") % len(weights) + 1)
    s = sizes.withColumn("_w", given).withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    up_to, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(up_to), F.lit(0.0))) / F.sum("_w").over(after))
    # the first source, in this order, that the level doesn't fill has the level of all the rest
    s = s.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(everything)["_level"])
    return s.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 9, has_keys: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, source, text; other columns are ignored, whatever their names): doc_id, size, source_size, target, taken and the row's key.

    A null text has size 0; a null source is a source of its own, the last; an
    empty table gives no rows. Rows of equal keys that differ in nothing may
    change places, which changes no result. Reruns agree: keys hash the row.
    """
    docs = docs if has_keys else keyed(docs.select("doc_id", "source", "text"))
    rows = docs.select(*KEY, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat_ws(":", F.lit(seed), "doc_id", F.md5("text"))).alias("_key"))
    placed = prefix_sums(rows, ["source"], ["_key", "doc_id", "size"], "size")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.join(targets, placed["source"].eqNullSafe(targets["_source"])).select(*KEY, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each epoch of a document, the cut one with its first words only; n_chars follows the text."""
    inner, back = aside(docs, ["doc_id", "source", "text", "n_chars"])
    rows = keyed(inner)
    plan = mix_plan(rows, has_keys=True, **options).select(*[F.col(k).alias(f"_p{k}") for k in KEY], "size", "taken").where("taken > 0")
    copies = rows.join(plan, (rows[KEY[0]] == plan[f"_p{KEY[0]}"]) & (rows[KEY[1]] == plan[f"_p{KEY[1]}"]))
    copies = copies.withColumn("_take", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div size as int)), e -> least(size, taken - e * size))")))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    text = F.when(F.col("_take") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("_take").cast("int")), " "))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return back(out)
