import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vector import cosine, digest_embedding, unit


@pytest.fixture(scope="module")
def one(spark):
    def value(expr, **columns):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expr.alias("x")).first()["x"] if columns else spark.range(1).select(expr.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize(
    "text, n",
    [
        ("One. Two! Three?", 3),
        ("Dr. Smith met Mr. Jones. They left.", 2),
        ("It cost 3.14 dollars. Fine.", 2),
        ("U. S. Army came. It won.", 2),
        ("See e.g. Smith and i.e. Jones.", 1),
        ("Wait... What happened? Nothing.", 2),
        ('He said "Go." "Why?" she asked.', 1),
        ("no capital follows. here it stays.", 1),
        ("Born in Jan. 1990 in Ft. Worth. Moved.", 2),
        ("Wide spaces.  　Next one.", 2),
        ("   ", 0),
    ],
)
def test_sentences(one, text, n):
    assert len(one(T.sentences("t"), t=text)) == n


def test_words_and_paragraphs(one):
    assert one(T.words("t"), t="A b　c  D") == ["a", "b", "c", "d"]
    assert one(T.word_count("t"), t=" a  b ") == 2
    assert one(T.paragraphs("t"), t="a\n\n b \n \n\nc") == ["a", "b", "c"]


def test_structure_and_params(one):
    for text, kind in (("<h1>a</h1> <H2 x>b</H2>", "html"), ("# a\ntext\n## b", "markdown"), ("a\n\nb\n\nc\n\nd", "paragraphs"), ("a", "plain"), ("# a", "plain")):
        assert one(T.structure("t"), t=text) == kind
    for n, pair in ((1999, (500, 50)), (2000, (1000, 100)), (5000, (1000, 100)), (5001, (1500, 200))):
        assert tuple(one(T.chunk_params(F.lit(n)))) == pair
    assert one(T.markdown_parts("t"), t="intro\n# A\nx\n### B\ny") == ["intro", "# A\nx", "### B\ny"]


def test_parsers(one):
    assert one(T.bullets("t"), t='- one\n* "two"\n3. three\n\n2024 trends\n• five') == ["one", "two", "three", "2024 trends", "five"]
    got = one(T.query_goals("t", 2), t="x\nQuery: a b\nGoal: g\n Query: c\nQuery: d\nGoal: z")
    assert [(g["query"], g["goal"]) for g in got] == [("a b", "g"), ("c", None)]
    got = one(T.learnings("t"), t="Learning [http://a.org/x]: first\nLearning: second http://b.org/y\nLearning: third\nother")
    assert [tuple(x) for x in got] == [("first", "http://a.org/x"), ("second", "http://b.org/y"), ("third", None)]
    assert one(T.questions("t", 1), t="Question: why?\nQuestion: how?") == ["why?"]
    assert one(T.json_object("t"), t='so {"a": {"b": 1}} then') == '{"a": {"b": 1}}'
    assert one(T.json_object("t", greedy=False), t='{"a": 1} and {"b": 2}') == '{"a": 1}'
    assert one(T.json_object("t"), t="so {bad json} then") is None and one(T.json_object("t"), t="none") is None
    for text, grade in (("A", "CORRECT"), ("b", "INCORRECT"), ("INCORRECT", "INCORRECT"), ("it is CORRECT", "CORRECT"), ("NOT_ATTEMPTED", "NOT_ATTEMPTED"), ("?", "NOT_ATTEMPTED")):
        assert one(T.grade("t"), t=text) == grade


def test_recalls(one):
    ctx, kw = F.lit("The quick Brown fox"), F.array(F.lit("quick"), F.lit("BROWN"), F.lit("cat"), F.lit("fo"))
    assert one(T.keyword_recall(ctx, kw)) == 0.75 and one(T.hit(ctx, kw))
    assert one(T.keyword_recall(ctx, F.array().cast("array<string>"))) == 1.0
    assert one(T.keyword_precision(ctx, F.array().cast("array<string>"))) == 0.0
    assert one(T.keyword_precision(ctx, kw)) == 0.5
    assert one(T.token_recall(ctx, F.lit("quick red FOX"))) == pytest.approx(2 / 3)
    assert one(T.token_recall(ctx, F.lit(""))) == 1.0
    assert one(T.phrase_recall(ctx, F.lit("quick brown, lazy dogs. no"))) == 0.5
    assert one(T.phrase_recall(ctx, F.lit("a. b."))) == 1.0


def test_small_functions(one):
    assert one(T.summary("t", 3), t="abcd") == "abc..." and one(T.summary("t", 4), t="abcd") == "abcd"
    assert one(T.placeholders("t"), t="x [IMAGE: a cat ] y [IMAGE: b]") == ["a cat", "b"]
    assert one(T.without_placeholders("t"), t="x [IMAGE: a]\ny") == "x y"
    assert one(T.site_query(F.lit("q"), F.array(F.lit("a"), F.lit("b")), True)) == "(site:a OR site:b) q"
    assert one(T.site_query(F.lit("q"), F.array().cast("array<string>"), False)) == "q"


def test_vectors(one):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert one(cosine(v(1, 0), v(1, 0, 0))) == 0 and one(cosine(v(0, 0), v(1, 0))) == 0
    assert one(cosine(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0
    assert one(unit(v(3, 4))) == pytest.approx([0.6, 0.8])
    assert len(one(digest_embedding(F.lit("x")))) == 8
