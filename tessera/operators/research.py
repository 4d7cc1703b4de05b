"""Research bookkeeping: page filters, routing, fetch lists, citations, levels and tool choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators import dedup
from tessera.sources.tables import written

#: Least characters of a page, names of tool actions.
LEAST_PAGE = 100
TOOL_PATTERNS = ("search", "get", "read", "fetch", "find", "list", "query", "lookup", "retrieve", "browse", "view", "show", "describe")


def long_enough(df: DataFrame, text: str = "raw_content", least: int = LEAST_PAGE) -> DataFrame:
    """P1, P2."""
    return df.where(F.length(text) >= least)


def prefetched(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with an address, those whose text is already there and those to fetch."""
    url = F.coalesce(F.nullif("href", F.lit("")), F.nullif("url", F.lit("")))
    text = F.coalesce(F.nullif("raw_content", F.lit("")), F.nullif("body", F.lit("")), F.lit(""))
    rows = hits.select(url.alias("url"), text.alias("raw_content"), "pos").where("url is not null")
    has = F.length("raw_content") > LEAST_PAGE
    return rows.where(has), rows.where(~has).select("url", "pos")


def allowed(df: DataFrame, excluded: list[str], url: str = "url") -> DataFrame:
    """Without addresses that hold an excluded name."""
    return df.where(~F.exists(F.array(*[F.lit(x) for x in excluded]).cast("array<string>"), lambda x: F.contains(F.col(url), x)))


def scraper(url: Column, configured: str = "bs") -> Column:
    """Which reader fetches an address."""
    return F.when(url.endswith(".pdf"), "pdf").when(url.contains("arxiv.org"), "arxiv").otherwise(configured)


def chosen_retrievers(headers: dict[str, str], config: dict[str, str], known: set[str], default: str = "tavily") -> list[str]:
    """Names from headers, then configuration; unknown ones become the default."""
    for place, key in ((headers, "retrievers"), (headers, "retriever"), (config, "retrievers"), (config, "retriever")):
        if place.get(key):
            return [n.strip() if n.strip() in known else default for n in place[key].split(",")]
    return [default]


def successes(pages: DataFrame) -> DataFrame:
    """P10: fetched pages as (url, raw_content, status); others keep what they have."""
    return pages.withColumn("raw_content", F.when(F.col("status") == "success", T.strip("raw_content")).otherwise(F.col("raw_content")))


def fetch_list(hits: DataFrame, visited: DataFrame) -> DataFrame:
    """Addresses to fetch, each once, without the visited."""
    return dedup.unvisited(prefetched(hits)[1], visited)


def scraped(hits: DataFrame, visited: DataFrame, pages: DataFrame) -> DataFrame:
    """Prefetched texts and the pages of what is left to fetch."""
    ready, _ = prefetched(hits)
    fetched = fetch_list(hits, visited).join(pages.select("url", "raw_content"), "url")
    return ready.select("url", "raw_content").unionByName(long_enough(fetched).select("url", "raw_content"))


def with_citations(learned: DataFrame, citations: DataFrame) -> DataFrame:
    """Each learning with its source, if it is known; of several the last."""
    last = citations.groupBy("learning").agg(F.max_by("url", "seq").alias("url"))
    text = F.when(F.coalesce("url", F.lit("")) != "", F.concat("learning", F.lit(" [Source: "), "url", F.lit("]"))).otherwise(F.col("learning"))
    return learned.join(last, "learning", "left").select("pos", text.alias("text"))


def map_updates(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Set and map updates of section 2.8: the last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value))


def level_sizes(spark: SparkSession, breadth: int, depth: int) -> DataFrame:
    """(level, breadth, nodes) of a research tree whose breadth halves, never below 2."""
    return spark.sql(f"""
        WITH RECURSIVE levels(level, breadth, nodes) AS (
          SELECT 1L, {int(breadth)}L, {int(breadth)}L
          UNION ALL
          SELECT level + 1, greatest(2L, breadth div 2), nodes * greatest(2L, breadth div 2) FROM levels WHERE level < {int(depth)})
        SELECT * FROM levels""")


#: Parameter: parts that the links of one address are dealt into, so that a hub's are no single task's.
PARTS = 16


def expanded(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, level) of what ``depth`` steps along ``edges`` (src, dst) reach from ``seeds`` (node): each node once, at its least level.

    One job a level: the open nodes meet their links, and what no earlier level
    has stays open. Links are dealt by source and a part of their target, once;
    the few open nodes go to all parts. Levels are written, so nothing is made
    twice. Null nodes and links to null drop.
    """
    links = written(edges.where("src is not null and dst is not null").distinct().withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(PARTS))).repartition("src", "part"), "links")
    found = [written(seeds.where("node is not null").select("node", F.lit(0).alias("level")).distinct(), "level")]
    for level in range(1, depth + 1):
        open_ = found[-1].select(F.col("node").alias("src"), F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")).alias("part"))
        met = links.join(open_, ["src", "part"]).select(F.col("dst").alias("node")).distinct()
        seen = found[0]
        for earlier in found[1:]:
            seen = seen.unionByName(earlier)
        found.append(written(met.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level")), "level"))
        if found[-1].isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def deep_research(seed: DataFrame, plan: Callable[[DataFrame, int], DataFrame], research: Callable[[DataFrame], DataFrame], breadth: int = 3, depth: int = 2) -> DataFrame:
    """Level by level, ``plan`` gives (node, query) children of the open nodes and ``research`` their (node, query, learning, url, context); one job a level."""
    out, open_ = None, seed
    for level in range(1, depth + 1):
        found = research(plan(open_, breadth)).withColumn("level", F.lit(level))
        out = found if out is None else out.unionByName(found)
        open_, breadth = found.select("node", F.col("learning").alias("query")), max(2, breadth // 2)
    return out


def query_variants(queries: DataFrame, strategy: str | None, model: Callable[[Column], Column] | None, insufficient: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, query). multi: the query and the model's list; hyde: the query and the model's answer; auto: expands queries of ``insufficient`` only."""
    first = queries.select("query_id", F.lit(0).alias("variant"), "query")
    if not strategy or model is None:
        return first
    if strategy == "auto" and insufficient is not None:
        queries = queries.join(insufficient.select("query_id"), "query_id", "left_semi")
    answers = F.array(model(F.col("query"))) if strategy == "hyde" else T.bullets(model(F.col("query")))
    more = queries.select("query_id", F.posexplode(answers).alias("variant", "query")).withColumn("variant", F.col("variant") + 1)
    return first.unionByName(more)


def insufficient(queries: DataFrame, hits: DataFrame, least_results: int = 3, least_score: float = 0.3) -> DataFrame:
    """Queries of too few hits or too low a best vector score."""
    g = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("vector_score").alias("best"))
    return queries.select("query_id").join(g, "query_id", "left").where((F.coalesce("n", F.lit(0)) < least_results) | (F.coalesce("best", F.lit(0.0)) < least_score))


def tool_scores(tools: DataFrame, most: int) -> DataFrame:
    """Three points for an action in the name, one in the description; the best of more than none, ties in input order."""
    name, text = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    score = sum((F.contains(name, F.lit(p)).cast("int") * 3 + F.contains(text, F.lit(p)).cast("int") for p in TOOL_PATTERNS), F.lit(0))
    return tools.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "pos").limit(most)


def tool_results(results: DataFrame) -> DataFrame:
    """JSON results (tool, pos, result) as (tool, pos, title, url, content): structured items, else content parts, else the object, else the text."""
    v = F.try_parse_json("result")
    text = lambda path: F.try_variant_get(v, path, "string")
    items = F.coalesce(F.try_variant_get(v, "$.structured_content.results", "array<variant>"), F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    parts = F.try_variant_get(v, "$.content", "array<variant>")
    one = lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.title", "string"), F.lit("")).alias("title"), F.coalesce(F.try_variant_get(x, "$.href", "string"), F.try_variant_get(x, "$.url", "string"), F.lit("")).alias("url"), F.coalesce(F.try_variant_get(x, "$.body", "string"), F.try_variant_get(x, "$.content", "string"), F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string")).alias("content"))
    whole = F.array(F.struct(F.coalesce(text("$.title"), F.lit("")).alias("title"), F.coalesce(text("$.href"), text("$.url"), F.lit("")).alias("url"), F.coalesce(text("$.body"), text("$.content"), text("$.text"), F.col("result")).alias("content")))
    rows = results.select("tool", "pos", F.explode(F.when(items.isNotNull(), F.transform(items, one)).when(parts.isNotNull(), F.transform(parts, one)).otherwise(whole)).alias("r"))
    return rows.select("tool", "pos", "r.title", "r.url", "r.content").where("content <> ''")


def quick_answers(hits: DataFrame) -> DataFrame:
    """Numbered lines of hits for a summary."""
    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("body", F.lit("")), F.lit(" ("), F.coalesce("href", F.lit("")), F.lit(")"))
    return hits.select("pos", line.alias("line"))


def spaced(arrivals: DataFrame, delay: float, group: str, at: str = "at", order: str = "event_id") -> DataFrame:
    """Section 2.9: starts at least ``delay`` apart: start_i = max over j <= i of at_j + delay * (i - j), a running maximum."""
    w = Window.partitionBy(group).orderBy(at, order)
    rows = arrivals.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    return rows.withColumn("start", F.col("_i") * delay + F.max(F.col(at) - F.col("_i") * delay).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def source_mode(mode: str, web: DataFrame | None = None, local: DataFrame | None = None, store: DataFrame | None = None) -> DataFrame:
    """C14: the documents of a mode: web, local, azure, docs (all local), vectorstore or hybrid (local, then web)."""
    chosen = {"web": web, "local": local, "azure": local, "docs": local, "vectorstore": store}
    if mode == "hybrid":
        return local.withColumn("side", F.lit("local")).unionByName(web.withColumn("side", F.lit("web")))
    if chosen.get(mode) is None:
        raise ValueError(f"no documents for mode {mode}")
    return chosen[mode]
