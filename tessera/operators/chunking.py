"""Chunkers: DataFrames of documents to DataFrames of chunks.

Documents are (doc_id, url, title, raw_content); chunks add chunk_index,
content, source and the four scores. Empty documents give no chunks (P1).
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.arrow import by_rows
from tessera.functions.html import heading_sections, parse
from tessera.functions.vector import Embed, cosine

SCORES = ["vector_score", "bm25_score", "hybrid_score", "rerank_score"]
#: Sections beyond so many characters are split by (size, overlap); paragraphs and groups below their bounds are merged.
LONG_SECTION, SECTION_SPLIT, SHORT_PARAGRAPH, SHORT_GROUP = 2000, (2000, 100), 2000, 100
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """pieces of at most ``size`` characters, cut at the coarsest separator that fits, each beginning with up to ``overlap`` of the last."""

    def atoms(t: str, level: int) -> list[str]:
        if len(t) <= size:
            return [t]
        sep = SEPARATORS[level]
        if not sep:
            return [t[i : i + size] for i in range(0, len(t), size)]
        return [a for part in re.split(f"(?<={re.escape(sep)})", t) if part for a in atoms(part, level + 1)]

    out, held, length, fresh = [], [], 0, False
    for atom in atoms(text, 0):
        if held and length + len(atom) > size:
            if fresh:
                out.append("".join(held))
            while held and (length > overlap or length + len(atom) > size):
                length -= len(held.pop(0))
        held.append(atom)
        length += len(atom)
        fresh = True
    if held and fresh:
        out.append("".join(held))
    return [c for c in (o.strip() for o in out) if c]


TEXTS = "array<string>", pa.list_(pa.string())


def splitter(size: int, overlap: int):
    """``split_text`` over Arrow batches."""
    return by_rows(lambda t: split_text(t or "", size, overlap), *TEXTS)


def _long_split(parts: list[str] | None, longest: int, size: int, overlap: int) -> list[str] | None:
    return None if parts is None else [s for t in parts for s in (split_text(t, size, overlap) if len(t) > longest else [t])]


def long_splitter(longest: int, size: int, overlap: int):
    """Arrays of parts with those beyond ``longest`` characters split on, in place."""
    return by_rows(lambda parts: _long_split(parts, longest, size, overlap), *TEXTS)


def _parts(kind: str, text: str | None, sections: list[str] | None, size: int, overlap: int) -> list[str] | None:
    """Pieces of a plain text by length; sections, those of HTML found here, with long ones split on."""
    if kind == "plain":
        return split_text(text or "", size, overlap)
    return _long_split(heading_sections(parse(text)) if kind == "html" else sections, LONG_SECTION, *SECTION_SPLIT)


def merged_short(parts: Column, least: int, sep: str) -> Column:
    """A left fold that appends a part below ``least`` characters to the one before."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(sep), part)))
        return F.when((F.size(done) > 0) & (F.length(part) < least), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def documents(df: DataFrame, text: str = "text", url: str = "source") -> DataFrame:
    """A table's rows as documents; missing addresses and titles are empty."""
    title = F.col("title") if "title" in df.columns else F.lit("")
    return df.select("doc_id", F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(title, F.lit("")).alias("title"), F.col(text).alias("raw_content"))


def _chunks(df: DataFrame, parts: Column) -> DataFrame:
    rows = df.where(F.length("raw_content") > 0).select("doc_id", F.posexplode(parts).alias("chunk_index", "content"), F.coalesce("url", F.lit("")).alias("source"), F.coalesce("title", F.lit("")).alias("title"))
    return rows.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "*", *[F.lit(0.0).alias(s) for s in SCORES])


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """F10 as a strategy of its own."""
    return _chunks(docs, splitter(size, overlap)("raw_content"))


def adaptive_chunks(docs: DataFrame) -> DataFrame:
    """by headings of HTML or markdown, by paragraphs, or by length, as the text's structure tells; long sections are split on.

    All within the row, in one scan: nothing is shuffled, and repeated
    documents keep chunks of their own.
    """
    docs = docs.where(F.length("raw_content") > 0).withColumn("_kind", T.structure("raw_content"))
    only = lambda kind: F.when(F.col("_kind") == kind, F.col("raw_content"))  # noqa: E731  others cost the functions nothing
    params = T.chunk_params(F.length("raw_content"))
    sections = F.when(F.col("_kind") == "markdown", T.markdown_parts(only("markdown"))).when(F.col("_kind") == "paragraphs", merged_short(T.paragraphs(only("paragraphs")), SHORT_PARAGRAPH, "\n\n"))
    walked = F.when(F.col("_kind").isin("html", "plain"), F.col("raw_content"))
    return _chunks(docs.withColumn("_parts", by_rows(_parts, *TEXTS)("_kind", walked, sections, params["size"], params["overlap"])), F.col("_parts"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.length("raw_content") > 0).select(*[c for c in docs.columns if c != "raw_content"], F.posexplode(T.sentences("raw_content")).alias("pos", "sentence"))


def breakpoints(sentences: DataFrame, key: str = "doc_id", spread: float = 0.3) -> DataFrame:
    """Sentences (key, pos, embedding) with ``part``, a number that grows where the likeness to the next sentence falls below mean - spread * deviation."""
    order, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    rows = sentences.withColumn("likeness", F.when(F.lead("pos").over(order).isNotNull(), cosine(F.col("embedding"), F.lead("embedding").over(order))))
    rows = rows.withColumn("limit", F.avg("likeness").over(whole) - spread * F.stddev_pop("likeness").over(whole))
    ends = (F.col("likeness") < F.col("limit")).cast("int")
    return rows.withColumn("part", F.coalesce(F.sum(F.coalesce(ends, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def semantic_chunks(docs: DataFrame, embed: Embed, overlap_sentences: int = 1, most: int = 1500) -> DataFrame:
    """sentences, grouped between breakpoints; short groups join the one before, each group begins with the last sentence of the one before."""
    docs = docs.withColumn("_text", F.xxhash64("raw_content"))  # rows of one doc_id may differ, and equal ones are chunked once
    unique = docs.dropDuplicates(["doc_id", "_text"]).select(F.struct("doc_id", "_text").alias("doc"), "raw_content")
    rows = breakpoints(sentence_rows(unique).withColumn("embedding", embed(F.col("sentence"))), "doc")
    groups = rows.groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
    groups = groups.select("doc", "part", F.transform("s", lambda x: x["sentence"]).alias("s"))
    by_doc = groups.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("g")).select("doc", F.transform("g", lambda x: x["s"]).alias("g"))
    none = F.array().cast("array<array<string>>")

    def join_short(done: Column, group: Column) -> Column:
        short = F.length(F.array_join(group, " ")) < SHORT_GROUP
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), group)))
        return F.when((F.size(done) > 0) & short, joined).otherwise(F.concat(done, F.array(group)))

    def overlap(done: Column, group: Column) -> Column:
        last = F.element_at(done, -1)
        tail = F.slice(last, F.greatest(F.lit(1), F.size(last) - overlap_sentences + 1), F.lit(max(overlap_sentences, 1)))
        return F.concat(done, F.array(F.when((F.size(done) > 0) & F.lit(overlap_sentences > 0), F.concat(tail, group)).otherwise(group)))

    folded = by_doc.withColumn("g", F.aggregate("g", none, join_short)).withColumn("g", F.aggregate("g", none, overlap))
    texts = folded.select("doc.*", F.transform("g", lambda g: F.array_join(g, " ")).alias("t")).withColumn("parts", long_splitter(most, most, 100)("t")).drop("t")
    return _chunks(docs.join(texts, ["doc_id", "_text"]), F.col("parts"))


#: Strategies by name (C10); a strategy that needs a model takes it as ``embed``.
STRATEGIES = {"fixed": fixed_chunks, "adaptive": adaptive_chunks, "semantic": semantic_chunks}


def chunker(name: str, embed: Embed | None = None):
    if name == "semantic":
        return partial(semantic_chunks, embed=embed)
    return STRATEGIES[name]
