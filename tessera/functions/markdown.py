"""Markdown as rows: headers with their parents, sections, contents, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import strip

HEADER = r"^(#{1,6})\s+(.+?)\s*#*$"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _row, pos, line): ``_row`` tells rows of one key apart."""
    rows = df.select(key, F.monotonically_increasing_id().alias("_row"), F.split(text, "\n").alias("_lines"))
    return rows.select(key, "_row", F.posexplode_outer("_lines").alias("pos", "line"))


def _nested(found: DataFrame, *more: str) -> DataFrame:
    """Header rows (_row, pos, level, text) with their parents: the last place of each level says it, a running maximum for each of the six levels."""
    before = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({f"_l{n}": F.max(F.when(F.col("level") == n, F.col("pos"))).over(before) for n in range(1, 7)})
    last = {n: F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 7)}
    lower = lambda n: F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_l{m}"), F.lit(-1)) for m in range(1, n)]) if n > 1 else F.lit(-1)
    depth = sum((F.coalesce((last[n] > lower(n)).cast("int"), F.lit(0)) for n in range(1, 7)), F.lit(0))  # a level is open if no lower one came after it
    return found.select(*more, "_row", "pos", "level", "text", F.greatest(*last.values()).alias("parent_pos"), depth.alias("depth"))


def _header_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    found = lines(df, key, text).where(F.col("line").rlike(HEADER))
    return _nested(found.select(key, "_row", "pos", F.length(F.regexp_extract("line", HEADER, 1)).alias("level"), F.regexp_extract("line", HEADER, 2).alias("text")), key)


def headers(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, text, parent_pos, depth): the parent is the last header before with a lower level. Rows of one key stay apart."""
    return _header_rows(df, key, text).drop("_row")


def sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, number, section_title, written_content) of headers with content."""
    parts = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(r"(?s)\n(#{1,6}\s+[^\n]+.*?)(?=\n#{1,6}\s|$)"), 1)
    rows = df.select(key, F.posexplode(parts).alias("number", "part"))
    rows = rows.select(key, "number", F.regexp_extract("part", r"^#{1,6}\s+([^\n]+)", 1).alias("section_title"), strip(F.regexp_replace(F.regexp_replace("part", r"^#{1,6}\s+[^\n]+", ""), r"(?s)<.*?>", "")).alias("written_content"))
    return rows.where("written_content <> ''").withColumn("section_title", strip("section_title"))


def contents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, toc): an indented line for each header; a row for each row of ``df``."""
    rows = lines(df, key, text).withColumn("_h", F.coalesce(F.col("line").rlike(HEADER), F.lit(False))).where("_h or pos is null or pos = 0")  # each row's first line stands for it
    rows = _nested(rows.select(key, "_row", "pos", "_h", F.when(F.col("_h"), F.length(F.regexp_extract("line", HEADER, 1))).alias("level"), F.regexp_extract("line", HEADER, 2).alias("text")), key, "_h")
    line = F.concat(F.repeat(F.lit(" "), F.col("depth") * 4), F.lit("- "), F.col("text"), F.lit("\n"))
    listed = rows.groupBy("_row").agg(F.first(key).alias(key), F.array_sort(F.collect_list(F.when(F.col("_h"), F.struct("pos", line.alias("line"))))).alias("l"))
    return listed.select(key, F.concat(F.lit("## Table of Contents\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("toc"))


def with_references(report: Column, urls: Column) -> Column:
    """the report and a list of its addresses."""
    listed = F.transform(urls, lambda u: F.concat(F.lit("- ["), u, F.lit("]("), u, F.lit(")\n")))
    return F.concat(report, F.lit("\n\n\n## References\n\n"), F.array_join(listed, ""))


def line_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, header, content, start_line, end_line) of headers of level 2 and 3."""
    by_line = Window.partitionBy("_row").orderBy("pos")
    rows = lines(df, key, text).withColumn("h", F.regexp_extract("line", r"^#{2,3}\s+(.+)$", 1))
    rows = rows.withColumn("island", F.sum((F.col("h") != "").cast("int")).over(by_line)).where("island > 0")
    rows = rows.groupBy("_row", "island").agg(F.first(key).alias(key), F.min("pos").alias("start_line"), F.max("pos").alias("end_line"), F.max("h").alias("header"), F.array_sort(F.collect_list(F.when(F.col("h") == "", F.struct("pos", "line")))).alias("l"))
    return rows.select(key, "header", strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content"), "start_line", "end_line")


def with_image(report: Column, header: Column, url: Column, alt: Column) -> Column:
    """An image line after the first line of that header, else the report as it is."""
    mark = F.concat(F.lit("\n!["), alt, F.lit("]("), url, F.lit(")\n"))
    pattern = F.concat(F.lit(r"(?m)^(#{2,3}\s+\Q"), header, F.lit(r"\E)$"))
    return F.when(url.isNull(), report).otherwise(F.regexp_replace(report, pattern, F.concat(F.lit("$1\n"), F.regexp_replace(mark, r"([\\$])", r"\\$1"))))
