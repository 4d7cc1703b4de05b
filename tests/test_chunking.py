import pytest
from pyspark.sql import functions as F

from tessera.functions.vector import digest_embedding
from tessera.operators import chunking


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"u{i}", f"t{i}", t) for i, t in enumerate(texts)], "doc_id long, url string, title string, raw_content string")


def test_split_text_bounds_and_overlap():
    text = " ".join(f"word{i}" for i in range(500))
    parts = chunking.split_text(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and len(parts) > 15
    for a, b in zip(parts, parts[1:]):
        head = b.split()[0]
        assert head in a  # overlap
    assert set(" ".join(parts).split()) == set(text.split())
    assert chunking.split_text("x" * 450, 200, 0) == ["x" * 200, "x" * 200, "x" * 50]
    assert chunking.split_text("", 10, 0) == [] and chunking.split_text("short", 10, 5) == ["short"]


def test_adaptive_by_structure(spark):
    md = "# A\n" + "a " * 20 + "\n## B\n" + "b " * 1500
    html = "<div><h1>One</h1><p>x</p><h2>Two</h2><p>y</p></div>"
    blocks = "\n\n".join(["p" * 1500, "q" * 700, "r" * 2500, "s" * 30])
    rows = chunking.adaptive_chunks(docs(spark, md, html, blocks, "plain text " * 100, "", None)).orderBy("doc_id", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {0, 1, 2, 3}
    assert by[0][0].content.startswith("# A") and by[0][1].content.startswith("## B") and len(by[0]) == 3
    assert [r.content for r in by[1]] == ["One x", "Two y"]
    # a short paragraph joins the one before, without a bound; then the long part is split
    assert sum(len(r.content) for r in by[2]) >= 4730 and all(len(r.content) <= 2000 for r in by[2])
    assert all(len(r.content) <= 500 for r in by[3])
    assert [r.chunk_index for r in by[2]] == list(range(len(by[2])))
    assert by[3][0].source == "u3" and by[3][0].vector_score == 0.0


def test_merge_short_is_a_left_fold(spark):
    got = spark.range(1).select(chunking.merged_short(F.array(*[F.lit(x) for x in ("aa", "bbbb", "c", "d", "eeee")]), 3, "+").alias("x")).first()["x"]
    assert got == ["aa", "bbbb+c+d", "eeee"]


def test_breakpoints(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [1.0, 0.0]]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors)] + [(2, 0, [1.0, 0.0])], "doc_id long, pos int, embedding array<double>")
    got = {(r.doc_id, r.pos): r.part for r in chunking.breakpoints(rows).collect()}
    assert [got[1, i] for i in range(5)] == [0, 0, 1, 1, 2] and got[2, 0] == 0


def test_semantic_chunks(spark):
    text = " ".join(f"Sentence number {i} says something about topic {i % 3} in a plain way." for i in range(50))
    rows = chunking.semantic_chunks(docs(spark, text, "One sentence only."), digest_embedding, most=500).orderBy("doc_id", "chunk_index").collect()
    first = [r.content for r in rows if r.doc_id == 0]
    assert len(first) > 1 and all(len(c) <= 500 for c in first)
    assert [r.content for r in rows if r.doc_id == 1] == ["One sentence only."]
    assert all(f"Sentence number {i} " in " ".join(first) for i in range(50))


def test_strategies(spark):
    assert chunking.chunker("fixed")(docs(spark, "a b c")).count() == 1
    with pytest.raises(KeyError):
        chunking.chunker("unknown")


def test_repeated_documents_keep_their_own_chunks(spark):
    """Two equal rows, and a third of the same doc_id with another text, are chunked each by itself."""
    text = "# One\n\nFirst part here.\n\n# Two\n\nSecond part there.\n\n# Three\n\nThird."
    docs = spark.createDataFrame([(1, "u", "t", text), (1, "u", "t", text), (1, "u", "t", "A short one. Of two sentences.")], "doc_id long, url string, title string, raw_content string")
    for chunks in (chunking.adaptive_chunks(docs), chunking.semantic_chunks(docs, lambda c: digest_embedding(c))):
        rows = chunks.collect()
        alone = [r for r in rows if "part" in r.content or "Third" in r.content]
        assert len(rows) == len(alone) + 1
        assert sorted(r.chunk_index for r in alone) == sorted([*range(len(alone) // 2)] * 2)
