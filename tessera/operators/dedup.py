"""Exact and near duplicates, first-wins distinct, catalogues."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import cosine
from tessera.operators import elimination


def first_wins(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Of rows with equal keys the first by ``pos``; one pass with partial aggregation, so a key of many rows is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def catalog(chunks: DataFrame, pos: str = "pos") -> DataFrame:
    """A1: (source, n_chunks, title, doc_type, first_pos): chunks of each source with what its first one says."""
    kind = F.col("doc_type") if "doc_type" in chunks.columns else F.lit("local")
    return chunks.withColumn("_type", kind).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n_chunks"), F.min_by("title", pos).alias("title"), F.min_by("_type", pos).alias("doc_type"), F.min(pos).alias("first_pos"))


def sources_in_order(hits: DataFrame, pos: str = "pos") -> DataFrame:
    """A10: distinct sources with the title of their first hit, in order of appearance; empty ones drop."""
    return hits.where("source <> ''").groupBy("source").agg(F.min_by("title", pos).alias("title"), F.min(pos).alias("first_pos"))


def near_pairs(chunks: DataFrame, threshold: float, group: str = "query_id") -> DataFrame:
    """Pairs of one group, the earlier first, above the cosine threshold. Groups are reranked hits, so bounded by top_k."""
    a = chunks.select(group, F.col("pos").alias("pos_a"), F.col("embedding").alias("ea"))
    b = chunks.select(group, F.col("pos").alias("pos_b"), F.col("embedding").alias("eb"))
    return a.join(b, group).where("pos_a < pos_b").withColumn("likeness", cosine("ea", "eb")).where(F.col("likeness") > threshold).select(group, "pos_a", "pos_b", "likeness")


def greedy_survivors(vectors: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """In order, each kept row meets the later kept ones; of a pair above the threshold the lower score goes, of equal ones the later."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    near, kept = unit @ unit.T > threshold, np.ones(len(vectors), bool)
    for i in range(len(vectors)):
        if kept[i]:
            for j in np.flatnonzero(near[i, i + 1 :] & kept[i + 1 :]) + i + 1:
                if scores[j] > scores[i]:
                    kept[i] = False
                    break
                kept[j] = False
    return kept


def drop_near_duplicates(hits: DataFrame, threshold: float = 0.85, group: str = "query_id", score: str = "sort_score", most: int | None = None) -> DataFrame:
    """Groups of any size, see :func:`tessera.operators.elimination.survivors`; with ``most``, the rows a group can have (a larger one is an error), whole groups in one task each, which needs no table in between."""
    if most is None:
        return elimination.survivors(hits, threshold, group, score)

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) > most:
            raise ValueError(f"a group of {len(batch)} rows, of {most} at most")
        batch = batch.sort_values("pos")
        vectors = np.array([np.asarray(e, np.float64) for e in batch["embedding"]])
        return batch[greedy_survivors(vectors, batch[score].to_numpy(), threshold)]

    return hits.groupBy(group).applyInPandas(fold, hits.schema)


def unvisited(urls: DataFrame, visited: DataFrame, pos: str = "pos") -> DataFrame:
    """Addresses that are not visited yet, each once, the first occurrence."""
    return first_wins(urls.join(visited.select("url").distinct(), "url", "left_anti"), ["url"], pos)


def top_images(images: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """By score, each file once, without what is selected already; (url, hash, score, pos) in, the first k out."""
    left = images.join(selected.select("url").distinct(), "url", "left_anti")
    best = first_wins(left.withColumn("_order", F.struct(-F.col("score"), "pos")), ["hash"], "_order")
    return best.orderBy(F.desc("score"), "pos").limit(k).drop("_order")


def union_sections(lists: DataFrame, most: int) -> DataFrame:
    """Distinct sections of several retrievals in order of first appearance, cut to ``most``."""
    return first_wins(lists, ["content"]).orderBy("pos").limit(most)


def adjacent(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Each row with its follower's value, without a join."""
    return df.withColumn(f"next_{value}", F.lead(value).over(Window.partitionBy(key).orderBy(pos)))


