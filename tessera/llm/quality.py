"""Operator 1: quality rules with adaptive thresholds.

Measures of each text are whole numbers; mergeable quantile sketches (counts by
value, exact to 512 and to one part in 256 beyond) of each language and source
give the thresholds: an upper fence for every measure, which a join then
applies. Sketches add up exactly in any order, so reruns agree and a source's
sketches merge into its language's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Table, aside

#: Fixed values of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: Parameters of the method: a measure's fence is u + REACH * (u - median) + FLOOR, u its quantile by UPPER (in hundredths; the upper quartile for measures
#: that junk shifts, so that a quarter of junk moves nothing, and a higher one where most texts have 0). A language's fence counts as PRIOR texts in its
#: sources' fences, and the fence of all languages as PRIOR texts in each language's: small groups lean on larger ones, by degrees.
REACH, PRIOR, FLOOR = 3, 30, 100
UPPER = {"symbols": 75, "repeats": 95, "lines": 97, "capitals": 75, "length": 75}

#: Columns that :func:`judge` adds.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "measures", "kept"]

#: Words and how many of them stand in a repeated 3-word window. Lambdas over one-element arrays name a value that is used more than once: w the words,
#: h the windows' hashes, q the places of repeated windows, sorted. To find these, s holds the hashes' upper bits with the places, sorted, which is fast;
#: should different hashes agree in those bits, or the places need more than 24, s holds pairs of whole hash and place. Either is exact.
_REPEATS = r"""
transform(array(filter(split(_t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w ->
  named_struct('n', size(w), 'r', if(size(w) < 4, 0L,
    transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
      if(size(array_distinct(h)) = size(h), 0L,
        transform(transform(array(if(size(h) < 16777216, array_sort(transform(h, (x, i) -> shiftleft(shiftright(x, 24), 24) | i)), cast(array() as array<bigint>))), s ->
            if(size(s) = size(h) and size(filter(s, (p, j) -> j > 0 and shiftright(p, 24) = shiftright(s[j - 1], 24) and h[int(p & 16777215)] <> h[int(s[j - 1] & 16777215)])) = 0,
              array_sort(filter(transform(s, (p, j) ->
                if((j > 0 and shiftright(p, 24) = shiftright(s[j - 1], 24)) or (j < size(s) - 1 and shiftright(p, 24) = shiftright(s[j + 1], 24)), int(p & 16777215), -1)), p -> p >= 0)),
              transform(array(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), z ->
                array_sort(filter(transform(z, (p, j) ->
                  if((j > 0 and p.x = z[j - 1].x) or (j < size(z) - 1 and p.x = z[j + 1].x), p.i, -1)), p -> p >= 0)))[0])), q ->
          if(size(q) < 2, 0L, aggregate(sequence(1, size(q) - 1), 3L, (a, j) -> a + least(3, q[j] - q[j - 1]))))[0]))[0])))[0]
"""

#: Lines that hold a word, less the distinct ones.
_LINES = r"transform(array(filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), l -> named_struct('n', size(l), 'd', size(l) - size(array_distinct(l))))[0]"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns and the measures (per ten thousand; length: hundredths of a character a word).

    A column of ``docs`` that bears the name of a result is replaced by it; all
    others come back, whatever their names.
    """
    docs, back = aside(docs.drop(*[c for c in docs.columns if c in RESULTS]), ["text"])
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("_t", text)
    df = df.withColumn("_w", F.expr(_REPEATS)).withColumn("_l", F.expr(_LINES))
    df = df.withColumn("n_words", F.col("_w.n").cast("long")).withColumn("n_repeat_words", F.col("_w.r").cast("long")).withColumn("n_dup_lines", F.col("_l.d").cast("long")).withColumn("_lines", F.col("_l.n"))
    df = df.withColumn("word_chars", F.length(F.translate("_t", WHITE, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("_capitals", F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")))
    df = df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))

    def share(part: Column, whole: Column, scale: int = 10_000) -> Column:
        return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(0).cast("long")

    return back(
        df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.struct(share(F.col("n_symbols"), F.col("word_chars")).alias("symbols"), share(F.col("n_repeat_words"), F.col("n_words")).alias("repeats"), share(F.col("n_dup_lines"), F.col("_lines")).alias("lines"), share(F.col("_capitals"), F.col("word_chars")).alias("capitals"), share(F.col("word_chars"), F.col("n_words"), 100).alias("length")).alias("measures"),
    )


def fences(rows: DataFrame) -> DataFrame:
    """(lang, source, one column for each measure): thresholds from the sketches of rows that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"measures.{m}").alias("v")) for m in UPPER]))
    each = rows.where("not base_failed").select("lang", "source", pairs.alias("p")).select("lang", "source", "p.m", "p.v")
    low = F.expr("greatest(0, length(bin(v)) - 9)")
    sketch = each.withColumn("k", low).withColumn("b", F.expr("shiftleft(shiftright(v, k), k)")).groupBy("lang", "source", "m", "b").agg(F.count("*").alias("n"))

    def fence(by: list[str]) -> DataFrame:
        """(by, m, n, f): texts and fence of each group, from the sum of its sketches."""
        s = sketch.groupBy(*by, "m", "b").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*by, "m").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        up_to = Window.partitionBy(*by, "m").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        s = s.withColumn("c", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(whole))
        upper = F.create_map(*[F.lit(x) for pair in UPPER.items() for x in pair])[F.col("m")]
        q = s.groupBy(*by, "m").agg(F.max("all").alias("n"), F.min(F.when(F.col("c") * 2 >= F.col("all"), F.col("b"))).alias("middle"), F.min(F.when(F.col("c") * 100 >= F.col("all") * upper, F.col("b"))).alias("u"))
        return q.select(*by, "m", "n", (F.col("u") + REACH * (F.col("u") - F.col("middle")) + FLOOR).alias("f"))

    def leaning(own: DataFrame, on: DataFrame, by: list[str]) -> DataFrame:
        on = on.select(*[F.col(c).alias(f"_{c}") for c in [*by, "m"]], F.col("f").alias("_f"))
        joined = own.join(on, own["m"].eqNullSafe(on["_m"]) & reduce(lambda x, c: x & own[c].eqNullSafe(on[f"_{c}"]), by, F.lit(True)))
        return joined.withColumn("f", F.expr(f"(n * f + {PRIOR} * _f) div (n + {PRIOR})")).drop("_f", "_m", *[f"_{c}" for c in by])

    languages = leaning(fence(["lang"]), fence([]), [])
    own = leaning(fence(["lang", "source"]), languages, ["lang"])
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == m, F.col("f"))).alias(m) for m in UPPER])


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) with the base columns, base_failed and kept.

    A null or empty text has no words and fails the base rules. Null languages
    and sources form groups of their own. Repeated rows count each; an empty
    table gives no rows; a column of ``docs`` that bears the name of a result is
    replaced by it.
    """
    docs, back = aside(docs.drop(*[c for c in docs.columns if c in RESULTS]), ["text", "lang", "source"])
    rows = Table(measured(docs), "measured").read()
    limits = fences(rows)
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(m).alias(f"_{m}") for m in UPPER])
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    over = F.lit(False)
    for m in UPPER:
        over = over | F.coalesce(F.col(f"measures.{m}") > F.col(f"_{m}"), F.lit(False))
    return back(joined.withColumn("kept", ~F.col("base_failed") & ~over), *RESULTS)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; see :func:`judge`."""
    inner, back = aside(docs, ["text", "lang", "source"])
    return back(judge(inner).where("kept"))
