"""Operator 2: SpotSigs fingerprints (Theobald et al. 2008).

A signature is a common word, the anchor, with the chain of content words that
follow it; in stretches without anchors, neighbouring words are signatures too.
Each depends on a few words only, so that an edit changes those of its place. A
text's fingerprint is its set of signatures. Likeness is the
Jaccard measure of two sets. Near duplicates among all texts are found in
partitions by set length: sets whose lengths differ too much are never compared,
as the ratio of lengths bounds the measure, and only sets that share one of
their rarest signatures are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import KEY, Table, drop_since, keyed, link_buckets, sieved, strata, verified

#: Anchors, common words of four languages.
ANCHORS = """
the of and to a in is that it for was on with as by be this are at from or an have not they which you were but all
de la le et les des en un du une que pour est par dans qui au sur pas avec il elle ce se ne plus sont
el y los las del por con no su para es al lo como mas pero sus
der die und den von zu das sich mit auf nicht ist im dem ein eine als auch
""".split()  # fmt: skip

#: Stands for a missing doc_id, which comes first.
LEAST = -(2**63) + 1

#: Content words in a chain, and words after an anchor from which on neighbouring words are signatures, up to the next anchor.
CHAIN = 2


#: Words of a text.
WORDS = r"filter(split(lower(_text_), '[^\\p{L}\\p{N}]+'), x -> x <> '')"

#: Parameter: cells that words are counted in; the driver holds one number for each, whatever the input.
CELLS = 65536


def _rule(rule: str, text: Column | str) -> Column:
    return F.expr(rule.replace("_text_", text if isinstance(text, str) else text._jc.toString()))


def commonness(docs: DataFrame) -> str:
    """How common words are: for each of CELLS cells, sixteen times the logarithm of its words' number in all ``docs`` (text), as SQL for array<int>."""
    cell = F.expr(f"pmod(xxhash64(x), {CELLS})").alias("cell")
    counted = docs.select(F.explode(_rule(WORDS, "text")).alias("x")).groupBy(cell).agg(F.count("*").alias("many"))
    found = {r["cell"]: int(16 * math.log2(1 + r["many"])) for r in counted.collect()}  # CELLS rows at most
    return "cast(split('" + ",".join(str(found.get(i, 0)) for i in range(CELLS)) + "', ',') as array<int>)"


def signatures(text: Column, common: str | None = None) -> Column:
    """The sorted distinct signatures (64 bits each) of a text: array<bigint>, empty for a text without words or signs.

    With ``common`` of :func:`commonness`: array<struct<c: int, h: bigint>>, the
    signatures h by c, the sum over their words, so that those of rare words
    come first. The order is the same in every text.
    """
    anchors = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))
    chain = ", ".join(f"coalesce(get(c, s.i - j + {k}), '')" for k in range(CHAIN))
    after, pair, alone = f"xxhash64(s.x, {chain})", f"xxhash64(x, coalesce(get(w, first + {CHAIN} + i + 1), ''))", "xxhash64(_text_)"
    weights, end, distinct, closed = "", "", "array_sort(array_distinct(", "))"
    if common:
        sums = " + ".join(f"coalesce(get(u, s.i - j + {k}), 0)" for k in range(CHAIN))
        beside = f"get(v, first + {CHAIN} + i) + coalesce(get(v, first + {CHAIN} + i + 1), 0)"
        after, pair, alone = (f"named_struct('c', {c}, 'h', {h})" for c, h in ((sums, after), (beside, pair), ("0", alone)))
        cells = f"transform(_words_, x -> coalesce(get({common}, cast(pmod(xxhash64(x), {CELLS}) as int)), 0))"
        weights, end = f"transform(array({cells.replace('_words_', 'w')}), v -> transform(array({cells.replace('_words_', 'c')}), u -> ", ")[0])[0]"
        distinct, closed = "transform(array(sort_array(", ")), o -> filter(o, (x, i) -> i = 0 or x.h <> o[i - 1].h))[0]"  # array_distinct compares all pairs of structs
    rule = rf"""
    transform(array({WORDS}), w ->
      transform(array(filter(w, x -> x not in ({anchors}))), c ->
        transform(array(filter(transform(w, (x, i) -> named_struct('x', x, 'i', i)), s -> s.x in ({anchors}))), a ->
          transform(array(concat(array(-{CHAIN}), transform(a, s -> s.i + 1), array(size(w) + 1))), p ->
            {weights}{distinct}concat(
              transform(a, (s, j) -> {after}),
              flatten(transform(slice(p, 1, size(p) - 1), (first, j) ->
                transform(slice(w, first + {CHAIN} + 1, greatest(0, p[j + 1] - 1 - first - {CHAIN})), (x, i) -> {pair}))),
              if(size(w) > 0 or _text_ = '', slice(array({alone}), 1, 0), array({alone}))){closed}{end})[0])[0])[0])[0]
    """
    return _rule(rule, text)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(set_: Column) -> Column:
    """A set as its length and its signatures in hexadecimal, in order."""
    return F.concat(F.size(set_).cast("string"), F.lit(":"), F.array_join(F.transform(set_, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


#: Runs of consecutive doc_ids that a task of a shuffle gets.
RUNS = 4


def _bounds(rows: DataFrame, runs: int) -> list[int]:
    """Values of k that part ``rows`` into about equal runs."""
    found = rows.select(F.percentile_approx("k", [i / runs for i in range(1, runs)], 10 * runs)).first()[0] if runs > 1 else []
    return sorted({b for b in found or [] if b > LEAST})


def _in_runs(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` (k) with ``run``, the number of bounds below k; they are looked up in two steps, so a row costs the square root of their number."""
    if not bounds:
        return rows.withColumn("run", F.lit(0))
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    block = f"size(filter({longs(b[-1] for b in blocks)}, b -> b < k))"
    inside = f"coalesce(size(filter(get(array({', '.join(map(longs, blocks))}), {block}), b -> b < k)), 0)"
    return rows.withColumn("run", F.expr(f"{block} * {step} + {inside}"))


def with_next(docs: DataFrame, runs: int, classes: DataFrame | None = None) -> tuple[DataFrame, Callable[[str], Column]]:
    """Keyed ``docs`` (doc_id, text) with ``next_text``, the text of the row that follows by ascending doc_id (null first; after the last row: the first), and their class from ``classes`` (key, doc_id, class_id), if given.

    Rows are dealt into ``runs`` runs of consecutive doc_ids, and the first rows
    of a run also stand, as guests, at the end of the run before. A row's class
    travels before it, so that one shuffle serves both. The driver sees one
    bound and one first doc_id for each run, nothing else.

    Guests and classes are among the rows given back, with ``own`` false; the
    function gives what the row that follows has in a column made since.
    """
    spark = docs.sparkSession
    k, kind = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), dict(docs.dtypes)["doc_id"]
    rows = docs.select(*KEY, k, "doc_id", "text", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("class_id"))
    if classes is not None:
        rows = rows.unionByName(classes.select(*KEY, k, "doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), "class_id"))
    bounds = _bounds(docs.select(k), runs)
    rows = _in_runs(rows, bounds)
    firsts = sorted((r["run"], r["k"]) for r in _in_runs(docs.select(k), bounds).groupBy("run").agg(F.min("k").alias("k")).collect())
    guests = spark.createDataFrame([(low, firsts[i - 1][0]) for i, (_, low) in enumerate(firsts)], "guest_k long, guest_run int")
    rows = rows.join(F.broadcast(guests), F.col("k") == F.col("guest_k"), "left")  # one row for each run
    own, guest = F.struct(F.col("run"), F.lit(0).alias("guest")), F.struct(F.col("guest_run").alias("run"), F.lit(1).alias("guest"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("guest_run").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select(*KEY, "k", "doc_id", "text", "kind", "class_id", "p.run", "p.guest")
    w = Window.partitionBy("run").orderBy("guest", "k", *KEY, "kind")
    following = lambda name: F.lead(name, 1 if classes is None else 2).over(w)
    rows = rows.withColumn("next_text", following("text"))
    if classes is not None:
        rows = rows.withColumn("class_id", F.lag("class_id").over(w))
    return rows.withColumn("own", F.expr("guest = 0 and kind = 1")), following


def fingerprint(docs: DataFrame, classes: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its fingerprint, its edited text's, how alike they and the next row's are; with ``classes`` also class_id of :func:`near_classes`.

    A null text is empty; an empty text's fingerprint is the empty set, alike
    to itself only. Rows of equal doc_id follow each other as they are stored.
    A single row is its own next. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = keyed(docs.select("doc_id", "text"))
    known = near_classes(docs, has_keys=True).select(*KEY, "doc_id", "class_id") if classes else None
    rows = docs.select(*KEY, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, following = with_next(rows, RUNS * int(spark.conf.get("spark.sql.shuffle.partitions")), known)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("case when own then concat(substring(text, 1, int(n_chars - n_chars div 4)), substring(next_text, 1, int(n_chars div 4))) end"))
    made = [F.when(F.col(c).isNotNull(), signatures(c)).alias(name) for c, name in (("text", "sigs"), ("edited", "edited_sigs"))]
    rows = rows.select("run", "guest", "k", *KEY, "kind", "own", "doc_id", "class_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *made)
    rows = rows.withColumn("next_sigs", following("sigs")).where("own")
    more = ["class_id"] if classes else []
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), *more)


def near_classes(docs: DataFrame, percent: int = 80, has_keys: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its key, doc_id, n_signatures, class_id, the smallest doc_id among its near duplicates and theirs.

    Equal sets are compared once. A first pass takes the signatures of the
    rarest words, a tenth of the set more than a partner may lack: a set that
    shares too few of them has no partner. How common a word is, each row reads
    from a table of fixed size, so that no join orders whole sets. What is left is taken from the texts
    whole and ordered rarest first; signatures of one set only count but aren't
    indexed. A set has a partner only if they share one of the first
    n - ceil(n * percent / 100) + 1, in its partition by length or the next, and
    the place of the first one in common bounds what they share. Empty sets form
    no class: their class is their own doc_id. A null text is empty; repeated
    rows are copies; other columns are ignored; an empty table gives no rows.
    ``has_keys``: ``docs`` comes from :func:`tessera.llm.common.keyed`.
    """
    mark, percent = len(Table.live), int(percent)
    docs = (docs if has_keys else keyed(docs.select("doc_id", "text"))).select(*KEY, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = docs.withColumn("sigs", signatures("text", commonness(docs)).getField("h")).withColumn("n", F.size("sigs").cast("long"))
    common = f"((n * {percent} + 99) div 100)"
    first = F.expr(f"slice(sigs, 1, cast(least(n, n - {common} + 1 + n div 10) as int))")
    rows = Table(made.select(*KEY, "doc_id", "n", F.unhex(F.sha2(F.array_join("sigs", " "), 256)).alias("digest"), F.when(F.col("n") > 0, first).alias("first")), "signatures")
    by_set = rows.read().where("n > 0").groupBy("digest").agg(F.first("first").alias("first"), F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("one"))
    starts = Table(by_set.withColumn("node", F.monotonically_increasing_id()), "starts")
    members = Table(rows.read().drop("first"), "members")
    rows.drop()

    each = starts.read().select("node", "n", F.explode("first").alias("h"))
    shared = Table(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"), "shared")
    met = each.join(shared.read(), "h").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("met")).where(f"met >= {common} div 10 + 1")
    sets = Table(starts.read().drop("first"), "sets")
    wanted = Table(met.select("node", "n").join(sets.read().select("node", "one.*"), "node"), "left")
    starts.drop()
    texts = sieved(docs.select(*KEY, "text"), wanted.read(), KEY)  # the join moves what is left, not all texts
    whole = Table(texts.join(wanted.read(), KEY).select("node", "n", signatures("text").alias("tokens")), "whole-signatures")

    each = whole.read().select("node", "n", F.explode("tokens").alias("h"))
    counts = Table(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    ordered = each.join(counts.read(), "h").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))  # of one set each
    ordered = ordered.where(f"size(s) >= {common}")
    bounds = ", ".join(map(str, strata(percent, whole.read().agg(F.max("n")).first()[0] or 1)))
    parts = F.expr(f"transform(array(size(filter(array({bounds}), b -> b <= n))), s -> array(s, s + 1))[0]")
    prefix = F.expr(f"slice(s, 1, cast(size(s) - {common} + 1 as int))")  # the signatures of this set only stand before
    index = ordered.select("node", "n", F.size("s").alias("size"), parts.alias("parts"), F.posexplode(prefix).alias("place", "s")).select("node", "n", (F.col("size") - F.col("place")).cast("long").alias("q"), "s.h", F.explode("parts").alias("part"))
    index = index.select(F.xxhash64("part", "h").alias("sig"), "node", "n", "q")

    labels = link_buckets(index, verified(whole.read().select("node", "tokens"), percent), percent)
    named = Table(sets.read().join(labels, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("class")), "classes")
    smallest = named.read().groupBy("class").agg(F.min("least").alias("class_id"))
    known = Table(named.read().join(smallest, "class").select("digest", "class_id"), "class-ids")
    found = Table(members.read().join(known.read(), "digest", "left").select(*KEY, "doc_id", F.col("n").alias("n_signatures"), F.coalesce("class_id", "doc_id").alias("class_id")), "found")
    drop_since(mark, keep=found)
    return found.read()
