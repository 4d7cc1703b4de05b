"""The inverted-file index against scoring every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.operators.vector_index import OTHER, VectorIndex
from tests.conftest import DATA


def top(df, key="chunk_id"):
    return sorted((r.query_id, r["rank"], r[key], round(r.vector_score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    chance = np.random.default_rng(6)
    centres = chance.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * chance.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(300)]  # copies of one row
    rows += [(2000, [0.0] * 16), (2001, []), (2002, [1.0, 2.0]), (2003, None)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)


def test_exact_search_equals_all_pairs_and_skips_cells(spark, clustered, tmp_path):
    index = VectorIndex.build(clustered, f"file://{tmp_path}/index")
    assert index.rows().count() == 1804 and index.rows().where(F.col("cell") == OTHER).count() == 4
    queries = clustered.where("chunk_id % 50 = 0 and chunk_id < 1500").select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = ranking.ranked(ranking.vector_scores(queries, clustered), "vector_score", "rank", pos="chunk_id", most=10)
    assert top(index.search(queries, 10)) == top(whole)
    one = queries.where("query_id = 50")
    found = index.search(one, 5, probes=0.05)
    assert top(found) == top(whole.where("query_id = 50 and rank < 5"))
    assert len(index.read_cells) < index.cells().count() / 2
    plan = index._scored(one.select("query_id", F.lit(3).alias("cell")), one, "chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert any("cell" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])
    odd = spark.createDataFrame([(1, [0.0] * 16), (2, [1.0, 2.0]), (3, [])], "query_id long, embedding array<double>")
    want = ranking.ranked(ranking.vector_scores(odd, clustered.where("embedding is not null")), "vector_score", "rank", pos="chunk_id", most=3).collect()
    got = index.search(odd, 3).collect()
    assert sorted((r.query_id, r.vector_score) for r in got) == sorted((r.query_id, r.vector_score) for r in want)


def test_recall_of_the_approximate_search(spark, clustered, tmp_path):
    index = VectorIndex.build(clustered, f"file://{tmp_path}/a")
    queries = clustered.where("chunk_id % 50 = 0 and chunk_id < 1500").select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = {(r.query_id, r.chunk_id) for r in ranking.ranked(ranking.vector_scores(queries, clustered), "vector_score", "rank", pos="chunk_id", most=10).collect()}
    found = {(r.query_id, r.chunk_id) for r in index.search(queries, 10, exact=False).collect()}
    assert len(whole & found) >= 0.9 * len(whole)


def test_recall_on_the_given_vectors(spark, tmp_path):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    index = VectorIndex.build(vectors, f"file://{tmp_path}/b")
    queries = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = {(r.query_id, r.chunk_id) for r in ranking.ranked(ranking.vector_scores(queries, vectors), "vector_score", "rank", pos="chunk_id", most=10).collect()}
    found = {(r.query_id, r.chunk_id) for r in index.search(queries, 10, exact=False).collect()}
    assert len(whole & found) >= 0.9 * len(whole)


def test_empty_index(spark, clustered, tmp_path):
    index = VectorIndex.build(clustered.limit(0), f"file://{tmp_path}/c")
    assert index.search(clustered.where("chunk_id = 1").select(F.col("chunk_id").alias("query_id"), "embedding"), 3).count() == 0
