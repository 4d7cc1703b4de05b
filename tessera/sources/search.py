"""Search connectors as data sources over canned answers, and their deterministic part.

``spark.read.format("canned_search").option("path", ...).option("query", ...)``
reads JSON lines of {"connector", "query", "answer"}; :func:`hits` turns a
connector's answers into (title, href, body, raw_content) rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import site_query

SCHEMA = "connector string, query string, pos int, item string"

#: Each connector's list inside its answer and the fields of title, address and body.
CONNECTORS: dict[str, tuple[str, str | None, str, str]] = {
    "arxiv": ("results", "title", "pdf_url", "summary"),
    "bing": ("webPages.value", "name", "url", "snippet"),
    "bocha": ("data.webPages.value", "name", "url", "summary"),
    "custom": ("", "title", "url", "raw_content"),
    "duckduckgo": ("", "title", "href", "body"),
    "exa": ("results", None, "url", "text"),
    "google": ("items", "title", "link", "snippet"),
    "pubmed_central": ("articles", "title", "href", "body"),
    "searchapi": ("organic_results", "title", "link", "snippet"),
    "searx": ("results", None, "url", "content"),
    "semantic_scholar": ("data", "title", "openAccessPdf.url", "abstract"),
    "serpapi": ("organic_results", "title", "link", "snippet"),
    "serper": ("organic", "title", "link", "snippet"),
    "tavily": ("results", None, "url", "content"),
    "xquik": ("tweets", None, "id", "text"),
    "mcp": ("", "title", "href", "body"),
}
#: Connectors whose video links drop before the limit, and those that never limit their answers themselves.
NO_VIDEOS, UNLIMITED = {"bing", "google", "searchapi", "serpapi", "serper"}, {"bing", "serper", "custom"}


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.query, self.parts = options["path"], options.get("query"), int(options.get("partitions", 1))

    def partitions(self):
        with open(self.path, encoding="utf-8") as f:
            n = sum(1 for _ in f)
        step = max(1, -(-n // self.parts))
        return [_Part(self.path, s, s + step) for s in range(0, n, step)] or [_Part(self.path, 0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        with open(part.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if part.start <= i < part.stop:
                    row = json.loads(line)
                    if self.query is not None and row["query"] != self.query:
                        continue
                    items = row["answer"]
                    for name in filter(None, CONNECTORS[row["connector"]][0].split(".")):
                        items = items.get(name, []) if isinstance(items, dict) else []
                    for pos, item in enumerate(items or []):
                        yield row["connector"], row["query"], pos, json.dumps(item)


class CannedSearch(DataSource):
    """Answers kept in a file that the driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "canned_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def answers(spark: SparkSession, path: str, query: str | None = None, parts: int = 1) -> DataFrame:
    spark.dataSource.register(CannedSearch)
    reader = spark.read.format("canned_search").option("path", path).option("partitions", parts)
    return (reader.option("query", query) if query is not None else reader).load()


def hits(rows: DataFrame, connector: str, most: int | None = None) -> DataFrame:
    """A connector's items (query, pos, item) as canonical hits, filtered and limited as the connector does."""
    _, title, href, body = CONNECTORS[connector]
    field = lambda name: F.get_json_object("item", f"$.{name}") if name else F.lit(None).cast("string")
    rows = rows.where(F.col("connector") == connector)
    if connector == "semantic_scholar":
        rows = rows.where((field("isOpenAccess") == "true") & field("openAccessPdf.url").isNotNull())
    out = rows.select("query", "pos", field(title).alias("title"), field(href).alias("href"), field(body).alias("body"), field("raw_content").alias("raw_content"), "item")
    if connector == "xquik":
        out = _tweets(out)
    if connector in NO_VIDEOS:
        out = out.where(~F.coalesce(F.col("href").contains("youtube.com"), F.lit(False)))
    if connector == "google":
        out = out.where("href is not null and title is not null and body is not null")
    if most is not None and connector not in UNLIMITED:
        from pyspark.sql.window import Window

        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).where(F.col("_n") <= most).drop("_n")
    return out.drop("item")


def _tweets(rows: DataFrame) -> DataFrame:
    """Titles cut to 120 characters, engagement below the text."""
    field = lambda name, default: F.coalesce(F.get_json_object("item", f"$.{name}"), F.lit(default))
    user, text = field("author.username", "unknown"), F.coalesce("body", F.lit(""))
    seen = F.when(~field("viewCount", "0").isin("0", ""), F.concat(F.lit(", "), field("viewCount", "0"), F.lit(" views"))).otherwise("")
    title = F.concat(F.lit("@"), user, F.lit(": "), F.left(text, F.lit(120)), F.when(F.length(text) > 120, "...").otherwise(""))
    body = F.concat(text, F.lit("\n\n["), field("likeCount", "0"), F.lit(" likes, "), field("retweetCount", "0"), F.lit(" RTs"), seen, F.lit("]"))
    return rows.withColumn("title", title).withColumn("href", F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), F.coalesce("href", F.lit("")))).withColumn("body", body)


def canonical(rows: DataFrame) -> DataFrame:
    """Hits of any shape: an empty string counts as missing (P3, 1.3)."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    return rows.select("pos", pick("title").alias("title"), pick("href", "url").alias("href"), pick("body").alias("body"), pick("raw_content", "body").alias("raw_content"))


def limited_query(connector: str, query: Column, domains: Column, excluded: Column | None = None) -> Column:
    """how a connector limits a query to domains."""
    if connector == "google":
        return site_query(query, domains, join_first=True)
    if connector == "serper" and excluded is not None:
        without = F.array_join(F.transform(excluded, lambda d: F.concat(F.lit("-site:"), d)), " ")
        query = F.when(F.size(excluded) > 0, F.concat(query, F.lit(" "), without)).otherwise(query)
    return site_query(query, domains, join_first=False)


def full_texts(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """The two-stage connector: found ids, then the articles that have a text."""
    return ids.join(articles, "article_id").where("body <> ''")
