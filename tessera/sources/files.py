"""Documents from files, records and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.html import page
from tessera.functions.text import strip
from tessera.sources import office

#: Suffixes read as plain text, and those whose readers aren't installed and give no rows.
TEXT, HTML, UNREAD = ("txt", "md", "csv"), ("html", "htm"), ("pdf", "doc", "xls")


def extension(path: Column) -> Column:
    """Lower-case suffix, without a query string."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\?.*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def from_files(files: DataFrame) -> DataFrame:
    """(path, content) of any file system as (url, title, raw_content); unknown kinds and empty texts drop."""
    name = F.element_at(F.split("path", "/"), -1).alias("url")
    typed = files.select("path", "content", extension(F.col("path")).alias("kind"))
    rows = typed.where(F.col("kind").isin(*TEXT, *HTML)).select(name, "kind", F.decode("content", "UTF-8").alias("text"))
    packed = office.texts(office.members(typed)).select(name, F.lit("").alias("title"), F.col("text").alias("raw_content"))
    plain = rows.where(F.col("kind").isin(*TEXT)).select("url", F.lit("").alias("title"), F.col("text").alias("raw_content"))
    read = rows.where(F.col("kind").isin(*HTML)).withColumn("page", page(F.col("text"), F.col("url"))).select("url", F.col("page.title").alias("title"), F.col("page.text").alias("raw_content"))
    return plain.unionByName(read).unionByName(packed).where("raw_content <> ''")


def unread(files: DataFrame) -> DataFrame:
    """(path, reason) of files that give no rows: kinds without a reader and broken office files; Spark doesn't list empty ones."""
    typed = files.select("path", "content", extension(F.col("path")).alias("kind"))
    strange = typed.where(~F.col("kind").isin(*TEXT, *HTML, *office.MEMBERS)).select("path", F.concat(F.lit("no reader for "), F.col("kind")).alias("reason"))
    broken = office.members(typed).where("error is not null").select("path", F.col("error").alias("reason"))
    return strange.unionByName(broken)


def load(spark: SparkSession, paths: str | list[str], require: bool = True) -> DataFrame:
    """A folder with all below it, or files; ``require`` raises where nothing could be read."""
    docs = from_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths))
    if require and docs.isEmpty():
        raise ValueError("no document could be read")
    return docs


def from_records(records: DataFrame, content: str = "page_content", title: str = "title") -> DataFrame:
    """Records with page_content and metadata as documents; the address is the metadata's title."""
    return records.select(F.col("metadata")[title].alias("url"), F.col(content).alias("raw_content"))


def scraped(pages: DataFrame, clean: bool = True) -> DataFrame:
    """(page_id, url, html) with text, title, images and links."""
    return pages.withColumn("page", page(F.col("html"), F.col("url"), clean)).select("page_id", "url", "page.*")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(url, page_no, text) as one text for each address, pages in order."""
    return pages.groupBy("url").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY page_no)").alias("raw_content"))


def papers(records: DataFrame) -> DataFrame:
    """(link, published, authors, summary, title): the link's last part is the query, date and authors come first."""
    text = F.concat(F.lit("Published: "), "published", F.lit("; Author: "), "authors", F.lit("; Content: "), "summary")
    return records.select(F.element_at(F.split("link", "/"), -1).alias("query"), text.alias("raw_content"), "title")


def evaluation(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """JSON lines, packed or not, or CSV; ``split`` is pushed to the scan."""
    rows = spark.read.option("header", True).csv(path) if path.split("?")[0].endswith(".csv") else spark.read.json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def crag_documents(records: DataFrame, stripped, most: int = 50_000) -> DataFrame:
    """a row for each search result: its page's text, else its snippet; a missing address or title is numbered."""
    rows = records.select("interaction_id", F.posexplode("search_results").alias("pos", "r"))
    text = strip(stripped(F.col("r.page_result")))
    text = F.when(text != "", text).otherwise(F.left(F.coalesce("r.page_snippet", F.lit("")), F.lit(most)))
    number = F.col("pos").cast("string")
    rows = rows.select("interaction_id", "pos", F.coalesce(F.nullif("r.page_url", F.lit("")), F.concat(F.lit("doc_"), number)).alias("url"), F.coalesce(F.nullif("r.page_name", F.lit("")), F.concat(F.lit("Document "), number)).alias("title"), text.alias("raw_content"))
    return rows.where("raw_content <> ''")
