"""Columns whose names an operator uses itself come back with the caller's values."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, quality, repeats, secrets, tokens
from tests.llm.fixtures import SCHEMA, awkward

NAMES = ["size", "taken", "before", "source_size", "_t", "_w", "_lang", "_source", "_symbols", "symbols", "_numbers", "_row", "_file", "_text", "_take", "_key", "_part", "n", "ids", "group", "kept", "n_words", "measures", "number", "candidate", "spans", "at", "_x0"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES]).repartition(2).cache()


def own(rows):
    return all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in NAMES if n in r)


@pytest.mark.parametrize("operator", [quality.keep, jaccard.one_of_each, secrets.redact, mixing.mix])
def test_all_columns_come_back(odd, operator):
    out = operator(odd)
    rows = out.collect()
    assert out.columns == odd.columns and rows and own(rows)


def test_results_stand_beside(spark, odd):
    judged = quality.judge(odd)
    assert own([{k: v for k, v in r.asDict().items() if k not in quality.RESULTS} for r in judged.collect()])
    plain = spark.createDataFrame(awkward(), SCHEMA)
    same = lambda f: sorted(map(str, f(odd).collect())) == sorted(map(str, f(plain).collect()))
    assert same(lambda d: jaccard.linked_sets(d).select("doc_id", "n_shingles", "component_id"))
    assert same(repeats.remove_repeats)
    assert same(lambda d: mixing.mix_plan(d).select("doc_id", "size", "source_size", "target", "taken"))
    assert odd.count() == packing.pack(odd, tokens.tokenizer_path("word_bpe_49k.json"), length=10**6).count()
