"""The chunkers against the SQL that was written apart from them, on awkward texts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import digest_embedding
from tessera.operators import chunking
from tessera.plans import chunk_sql

ATOMS = ["Dr. Who", "e.g. That", "éch. Now", "A. B", "wait... What", "yes! \"No", " ", "  ", "\n", "\n\n", "\n\n\n", "\n \n", "\t", " ", " ", "# Head", "\n## Part ", "\n#", "###", "👍🏽", "é", "word", "ein langes Wort", "x" * 700, "no. Or Fig. 7", "9. Done", "q" * 90 + ". "]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ATOMS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.choice([1, 5, 40, 300, 1500]))) for _ in range(120)]
    return [None, "", " ", "\n\n\n\n\n", "a" * 1000, "a" * 1001, "ab " * 40_000, "# a\n#\n# b", *made]


@pytest.fixture(scope="module")
def both(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts())]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return chunking.documents(spark.createDataFrame(rows, "doc_id long, text string, source string")), con


def digests(chunks):
    return sorted(map(tuple, chunks.select("doc_id", "chunk_index", F.md5("content"), F.length("content")).collect()))


def test_sentences(both):
    docs, con = both
    mine = docs.transform(chunking.sentence_rows).select("doc_id", "pos", "sentence")
    assert sorted(map(tuple, mine.collect())) == sorted(con.execute(f"SELECT doc_id, pos, sentence FROM ({chunk_sql.SENTENCES})").fetchall())


@pytest.mark.parametrize(("size", "overlap"), [(1000, 100), (500, 50), (50, 0), (40, 39), (7, 3)])
def test_fixed(both, size, overlap):
    docs, con = both
    short = docs.where("length(raw_content) < 20000 OR raw_content IS NULL") if size < 100 else docs
    sql = chunk_sql.fixed(size, overlap)
    want = con.execute(sql.replace("WHERE text <> ''", "WHERE text <> '' AND length(text) < 20000") if size < 100 else sql).fetchall()
    assert digests(chunking.fixed_chunks(short, size, overlap)) == sorted(want)


def test_adaptive(both):
    docs, con = both
    got = digests(chunking.adaptive_chunks(docs))
    assert got == sorted(con.execute(chunk_sql.adaptive("text")).fetchall())
    kinds = {r[0] for r in docs.select(chunking.T.structure("raw_content")).collect()}
    assert {"markdown", "paragraphs", "plain"} <= kinds


def test_semantic(both):
    docs, con = both
    assert digests(chunking.semantic_chunks(docs, digest_embedding)) == sorted(con.execute(chunk_sql.semantic()).fetchall())


def test_html_is_an_error_in_sql_and_not_left_out():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, '<h1>a</h1>b<h2>c</h2>' AS text, 's' AS source")
    with pytest.raises(duckdb.Error, match="HTML"):
        con.execute(chunk_sql.adaptive("text")).fetchall()
