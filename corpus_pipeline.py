"""The corpus pipeline: quality rules, n-gram Jaccard join, secret scans, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, quality, secrets, tokens
from tessera.llm.common import Table, drop_since
from tessera.llm.queries import VOCABULARY, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, tokens.tokenizer_path(VOCABULARY)))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("packing", packing_sequences),
]

#: SQL can't express the tokenizer of the last stage: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents, each written to the shared folder and read again; the last one's input goes with the session."""
    docs, mark = documents(spark, sf_dir), len(Table.live)
    for _, stage in STAGES[:-1]:
        kept = Table(stage(spark, docs, sf_dir), "stage")
        drop_since(mark, keep=kept)  # the stage before and what this one wrote on its way
        docs = kept.read()
    return STAGES[-1][1](spark, docs, sf_dir)
