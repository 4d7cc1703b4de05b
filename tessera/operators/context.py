"""Cited contexts: formats, budgets, fast paths and compressors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.functions.vector import Embed, cosine
from tessera.operators import dedup, ranking
from tessera.operators.chunking import splitter
from tessera.sources.tables import written

#: Bounds below which contexts skip their compressor, and the similarity that passes.
SMALL_CONTEXT, SMALL_DOCUMENTS, SIMILARITY, WRITTEN_SIMILARITY, WORD_BUDGET = 2000, 8000, 0.35, 0.5, 25_000


def chunk_entry() -> Column:
    """A19: "Source, Title, Content" of a chunk; no title line without a title."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("\nTitle: "), "title")).otherwise("")
    return F.concat(F.lit("Source: "), F.coalesce("source", F.lit("unknown")), title, F.lit("\nContent: "), "content")


def document_entry() -> Column:
    """F40, the default family's format."""
    return F.concat(F.lit("Source: "), F.coalesce("source", F.lit("None")), F.lit("\nTitle: "), F.coalesce("title", F.lit("None")), F.lit("\nContent: "), "content", F.lit("\n"))


def granite_entry() -> Column:
    """F40, the documents family."""
    return F.concat(F.lit("Document "), F.coalesce("source", F.col("pos").cast("string")), F.lit("\nTitle: "), F.coalesce("title", F.lit("None")), F.lit("\n"), "content")


def granite33_entry() -> Column:
    """F40, the roles family."""
    body = T.strip(F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Title: "), "title", F.lit("\n"))).otherwise(""), "content"))
    return F.concat(F.lit('<|start_of_role|>document {"document_id": "'), F.coalesce("source", F.col("pos").cast("string")), F.lit('"}<|end_of_role|>\n'), body, F.lit("<|end_of_text|>\n"))


#: A family's entry, what parts entries, and what stands around them all.
FAMILIES = {
    "default": (document_entry, "\n", "", ""),
    "granite3": (granite_entry, "\n\n", "<|start_of_role|>documents<|end_of_role|>\n", "\n<|end_of_text|>"),
    "granite3.3": (granite33_entry, "\n", "", ""),
}


def in_order(entry: Column, order: str, sep: str) -> Column:
    """An aggregate: entries joined in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))), lambda x: x["e"]), sep)


def formatted(docs: DataFrame, group: str = "query_id", order: str = "pos", top_n: int | None = None, family: str = "default") -> DataFrame:
    """One context for each group."""
    entry, sep, head, tail = FAMILIES[family]
    rows = docs if top_n is None else docs.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= top_n)
    out = rows.groupBy(group).agg(in_order(entry(), order, sep).alias("context"))
    return out.withColumn("context", F.concat(F.lit(head), "context", F.lit(tail)))


def joined_contexts(local: Column, web: Column, family: str = "default") -> Column:
    """contexts of local documents and of the web."""
    if family == "default":
        return F.concat(F.lit("Context from local documents: "), local, F.lit("\n\nContext from web sources: "), web)
    if family == "granite3":
        _, _, head, tail = FAMILIES[family]
        first = F.when(local.startswith(head), F.substring(local, F.lit(len(head) + 1), F.length(local))).otherwise(local)
        last = F.when(web.endswith(tail), F.left(web, F.length(web) - len(tail))).otherwise(web)
        return F.concat(F.lit(head), first, F.lit("\n\n"), last, F.lit(tail))
    return F.concat(local, F.lit("\n\n"), web)


def tool_and_web(web: Column, tools: Column) -> Column:
    """the web's context, then each tool result (content, url, title) that has content, with its citation."""

    def entry(x: Column, i: Column) -> Column:
        name = F.coalesce(x["title"], F.concat(F.lit("MCP Result "), (i + 1).cast("string")))
        cited = F.when((F.coalesce(x["url"], F.lit("")) != "") & (x["url"] != "mcp://llm_analysis"), F.concat(F.lit("\n\n*Source: "), name, F.lit(" ("), x["url"], F.lit(")*"))).otherwise(F.concat(F.lit("\n\n*Source: "), name, F.lit("*")))
        return F.when(T.strip(x["content"]) != "", F.concat(T.strip(x["content"]), cited))

    section = F.array_join(F.filter(F.transform(tools, entry), lambda e: e.isNotNull()), "\n\n---\n\n")
    return F.array_join(F.filter(F.array(T.strip(F.coalesce(web, F.lit(""))), section), lambda x: x != ""), "\n\n")


def concatenated(df: DataFrame, group: str, order: str = "pos", text: str = "context", sep: str = " ") -> DataFrame:
    """Contexts that aren't empty, in order."""
    return df.where(F.coalesce(text, F.lit("")) != "").groupBy(group).agg(in_order(F.col(text), order, sep).alias(text))


def word_budget(df: DataFrame, group: str, order: str = "pos", text: str = "text", most: int = WORD_BUDGET) -> DataFrame:
    """The last entries of each group whose words fit the budget; the first that doesn't ends it."""
    from_end = Window.partitionBy(group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n_words", T.word_count(text)).withColumn("up_to", F.sum("n_words").over(from_end)).where(F.col("up_to") <= most)


def gate(df: DataFrame, group: str, most_chars: int, most_rows: int, text: str = "content") -> DataFrame:
    """A3: (group, chars, n, fast): is the group small enough to be passed on as it is?"""
    g = df.groupBy(group).agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("n"))
    return g.withColumn("fast", (F.col("chars") < most_chars) & (F.col("n") <= most_rows))


def compressed(hits: DataFrame, most: int = 10, threshold: float = 0.85, least_similarity: float | None = None, most_hits: int | None = None) -> DataFrame:
    """C4: (query_id, context). Small sets keep their order; others lose near duplicates and are cut to the best ``most``. ``most_hits``: the hits a query can have, where that is bounded."""
    hits = written(hits.withColumn("_row", F.monotonically_increasing_id()), "hits")  # a row is known by its number; texts stay here until the rows are chosen
    small = written(gate(hits, "query_id", SMALL_CONTEXT, most).select("query_id", "fast"), "small")
    rows = hits.select("query_id", "_row", "pos", "embedding", "rerank_score", "hybrid_score", "vector_score").join(small, "query_id")
    fast = rows.where("fast").withColumn("rank", F.col("pos").cast("long"))
    slow = rows.where("not fast").withColumn("sort_score", ranking.sort_score())
    if least_similarity is not None:
        slow = slow.where(F.col("vector_score") >= least_similarity)
    kept = ranking.ranked(dedup.drop_near_duplicates(slow, threshold, most=most_hits), "sort_score", "rank", most=most)
    chosen = fast.select("query_id", "_row", "rank").unionByName(kept.select("query_id", "_row", F.col("rank").cast("long").alias("rank")))
    found = written(chosen, "chosen").join(hits.select("_row", "source", "title", "content"), "_row")
    return found.groupBy("query_id").agg(in_order(chunk_entry(), "rank", "\n").alias("context"))


def similar(queries: DataFrame, docs: DataFrame, embed: Embed, threshold: float, most: int, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Split, embedded and filtered pieces of documents (doc_id, source, title, content): the best ``most`` of each query."""
    pieces = docs.select("doc_id", "source", "title", F.posexplode(splitter(size, overlap)("content")).alias("piece", "content"))
    pieces = pieces.withColumn("embedding", embed(F.col("content"))).withColumn("pos", F.struct("doc_id", "piece"))
    scored = pieces.join(queries.select("query_id", F.col("embedding").alias("q"))).withColumn("similarity", cosine("q", "embedding"))
    return ranking.ranked(scored.where(F.col("similarity") >= threshold), "similarity", "rank", most=most).drop("q", "embedding")


def context_of(queries: DataFrame, docs: DataFrame, embed: Embed, most: int = 5, threshold: float = SIMILARITY, family: str = "default") -> DataFrame:
    """(query_id, context) over all of ``docs``: as they are if few and short, else their similar pieces."""
    few = docs.agg(((F.coalesce(F.sum(F.length("content")), F.lit(0)) < SMALL_DOCUMENTS) & (F.count("*") <= most)).alias("fast"))
    direct = docs.join(F.broadcast(few)).where("fast").join(queries.select("query_id")).select("query_id", F.col("doc_id").alias("pos"), "source", "title", "content")
    pieces = similar(queries, docs.join(F.broadcast(few)).where("not fast"), embed, threshold, most)
    rows = direct.select("query_id", F.col("pos").cast("long").alias("pos"), "source", "title", "content").unionByName(pieces.select("query_id", F.col("rank").cast("long").alias("pos"), "source", "title", "content"))
    return formatted(rows, top_n=most, family=family)


def written_contents(queries: DataFrame, sections: DataFrame, embed: Embed, most: int = 5, threshold: float = WRITTEN_SIMILARITY) -> DataFrame:
    """Similar pieces of written sections as "Title, Content" entries, a row each."""
    docs = sections.select("doc_id", F.lit(None).cast("string").alias("source"), F.coalesce("section_title", F.lit("")).alias("title"), F.coalesce("written_content", F.lit("")).alias("content"))
    entry = F.concat(F.lit("Title: "), "title", F.lit("\nContent: "), "content", F.lit("\n"))
    return similar(queries, docs, embed, threshold, most).select("query_id", "rank", entry.alias("content"))


def written_for_titles(titles: DataFrame, sections: DataFrame, embed: Embed, most: int = 10, threshold: float = WRITTEN_SIMILARITY) -> DataFrame:
    """Distinct entries over the subtopic and all draft titles (query_id, embedding), cut to ``most``."""
    rows = written_contents(titles, sections, embed, most, threshold)
    return dedup.union_sections(rows.withColumn("pos", F.struct("query_id", "rank")).select("content", "pos"), most)


def store_context(query: DataFrame, chunks: DataFrame, k: int = 8, where: dict | None = None, family: str = "default") -> DataFrame:
    """The ``k`` most similar stored chunks that fulfil all equalities of ``where``, formatted."""
    for name, value in (where or {}).items():
        chunks = chunks.where(F.col(name) == F.lit(value))
    scored = ranking.vector_scores(query, chunks).join(chunks, "chunk_id")
    return formatted(ranking.ranked(scored, "vector_score", "rank", most=k).drop("pos").withColumnRenamed("rank", "pos"), family=family)


def hashable(context: DataFrame) -> DataFrame:
    """entries (title, content, text) as text, each once in order."""
    entry = F.when(F.col("content").isNotNull(), F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nContent: "), "content")).otherwise(F.col("text"))
    return dedup.first_wins(context.select(entry.alias("entry"), "pos"), ["entry"])
