import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger, metrics, reports, research
from tessera.sources import files, search


def test_fetch_lists(spark):
    hits = spark.createDataFrame([(0, "u1", None, "x" * 101, None), (1, "", "u2", "s", ""), (2, "u2", None, "", None), (3, None, None, "x" * 200, None), (4, "u3", None, "s", "y" * 150)], "pos int, href string, url string, body string, raw_content string")
    ready, rest = research.prefetched(hits)
    assert sorted(r.url for r in ready.collect()) == ["u1", "u3"] and sorted(r.url for r in rest.collect()) == ["u2", "u2"]
    visited = spark.createDataFrame([("u9",)], "url string")
    assert [(r.url, r.pos) for r in research.fetch_list(hits, visited).collect()] == [("u2", 1)]
    pages = spark.createDataFrame([("u2", "z" * 100), ("u4", "w" * 100)], "url string, raw_content string")
    assert sorted(r.url for r in research.scraped(hits, visited, pages).collect()) == ["u1", "u2", "u3"]


def test_routing_and_choice(spark):
    rows = spark.createDataFrame([("http://a/x.pdf",), ("https://arxiv.org/abs/1",), ("http://b",)], "u string").select(research.scraper(F.col("u")).alias("s")).collect()
    assert [r.s for r in rows] == ["pdf", "arxiv", "bs"]
    known = set(search.CONNECTORS)
    assert research.chosen_retrievers({"retrievers": "bing, nope"}, {}, known) == ["bing", "tavily"]
    assert research.chosen_retrievers({}, {"retriever": "exa"}, known) == ["exa"] and research.chosen_retrievers({}, {}, known) == ["tavily"]
    with pytest.raises(ValueError):
        research.source_mode("static")


def test_variants_and_sufficiency(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, query string")
    model = lambda c: F.concat(F.lit("- x "), c, F.lit("\n- y"))
    assert research.query_variants(q, None, model).count() == 2
    assert [(r.query_id, r.variant, r.query) for r in research.query_variants(q, "multi", model).orderBy("query_id", "variant").collect()][:3] == [(0, 0, "a"), (0, 1, "x a"), (0, 2, "y")]
    assert research.query_variants(q, "hyde", model).count() == 4
    hits = spark.createDataFrame([(0, 0.9)] * 3 + [(1, 0.2)] * 3, "query_id long, vector_score double")
    lacking = research.insufficient(q, hits)
    assert [r.query_id for r in lacking.collect()] == [1]
    assert research.query_variants(q, "auto", model, lacking).count() == 4


def test_levels_and_deep_research(spark):
    assert [tuple(r) for r in research.level_sizes(spark, 4, 3).orderBy("level").collect()] == [(1, 4, 4), (2, 2, 8), (3, 2, 16)]
    seed = spark.createDataFrame([("0", "q")], "node string, query string")
    plan = lambda open_, b: open_.select(F.col("node").alias("p"), "query", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("i")).select(F.concat_ws(".", "p", "i").alias("node"), F.concat_ws("/", "query", "i").alias("query"))
    find = lambda nodes: nodes.select("node", "query", F.concat(F.lit("learned "), "query").alias("learning"), F.lit("u").alias("url"), F.lit("c").alias("context"))
    got = research.deep_research(seed, plan, find, breadth=4, depth=2).groupBy("level").count().orderBy("level").collect()
    assert [tuple(r) for r in got] == [(1, 4), (2, 8)]


def test_tools(spark):
    tools = spark.createDataFrame([(0, "web_search", "find pages"), (1, "calc", "adds"), (2, "fetch_list", None)], "pos int, name string, description string")
    assert [(r.name, r.score) for r in research.tool_scores(tools, 5).collect()] == [("fetch_list", 6), ("web_search", 4)]
    results = [
        {"structured_content": {"results": [{"title": "A", "href": "u", "body": "x"}, {"title": "B", "body": ""}]}},
        [{"title": "C", "url": "v", "content": "y"}],
        {"content": [{"type": "text", "text": "z"}]},
        {"title": "D", "content": "w"},
    ]
    rows = spark.createDataFrame([("t", i, json.dumps(r)) for i, r in enumerate(results)] + [("t", 9, "plain words")], "tool string, pos int, result string")
    got = [(r.pos, r.title, r.url, r.content) for r in research.tool_results(rows).orderBy("pos").collect()]
    assert got == [(0, "A", "u", "x"), (1, "C", "v", "y"), (2, "", "", "z"), (3, "D", "", "w"), (9, "", "", "plain words")]


def test_spacing(spark):
    rows = spark.createDataFrame([(0, "a", 0.0), (1, "a", 0.5), (2, "a", 5.0), (3, "a", 5.1)], "event_id int, g string, at double")
    assert [r.start for r in research.spaced(rows, 1.0, "g").orderBy("event_id").collect()] == pytest.approx([0.0, 1.0, 5.0, 6.0])


def test_metrics_and_costs(spark):
    grades = spark.createDataFrame([("CORRECT",)] * 6 + [("INCORRECT",)] * 2 + [("NOT_ATTEMPTED",)] * 2, "grade string")
    g = metrics.graded(grades).first()
    assert (g.correct_rate, g.accuracy, g.answer_rate) == (0.6, 0.75, 0.8) and g.f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    none = metrics.graded(grades.limit(0)).first()
    assert none.n == 0 and none.f1 == 0
    r = metrics.flagged_rate(spark.createDataFrame([(True,), (None,), (False,), (True,)], "f boolean"), "f").first()
    assert (r.evaluated, r.flagged) == (3, 2) and r.rate == pytest.approx(2 / 3)
    cost = spark.range(1).select(ledger.model_cost(F.lit(500), F.lit(500), F.lit("GPT-4")).alias("a"), ledger.model_cost(F.lit(1), F.lit(1), F.lit("x")).alias("b"), ledger.with_commas(F.lit(1234567)).alias("c")).first()
    assert cost.a == pytest.approx(0.03) and cost.b == 0.0001 and cost.c == "1,234,567"
    steps = {r.step: r.cost for r in ledger.step_costs(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "step string, cost double")).collect()}
    assert steps == {"a": 3.0, "b": 4.0, None: 7.0}


def test_reports(spark):
    schema = "id string, question string, seq long"
    store = spark.createDataFrame([("a", "q1", 1), ("b", "q2", 2)], schema)
    out = reports.upserted(store, spark.createDataFrame([("a", "q3", 3)], schema))
    assert {(r.id, r.question) for r in out.collect()} == {("a", "q3"), ("b", "q2")}
    ids = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a")], "pos int, id string")
    assert [r.id for r in reports.listed(out, ids).collect()] == ["b", "a"]
    assert reports.deleted(out, "a").count() == 1
    merged = reports.merged(store, spark.createDataFrame([("a", None), ("c", "new")], "id string, question string"))
    assert {(r.id, r.question) for r in merged.collect()} == {("a", "q1"), ("b", "q2"), ("c", "new")}


def test_search_connectors(spark, tmp_path):
    def line(connector, query, answer):
        return json.dumps({"connector": connector, "query": query, "answer": answer})

    google = {"items": [{"title": "a", "link": "https://youtube.com/x", "snippet": "s"}, {"title": "b", "link": "u"}, {"title": "c", "link": "v", "snippet": "t"}, {"title": "d", "link": "w", "snippet": "t"}]}
    scholar = {"data": [{"title": "p", "isOpenAccess": True, "openAccessPdf": {"url": "pdf"}, "abstract": "ab"}, {"title": "q", "isOpenAccess": False}]}
    tweet = {"tweets": [{"id": "7", "text": "x" * 130, "author": {"username": "me"}, "likeCount": 2, "retweetCount": 1, "viewCount": 9}]}
    path = tmp_path / "answers.jsonl"
    path.write_text("\n".join([line("google", "q", google), line("semantic_scholar", "q", scholar), line("xquik", "q", tweet), line("searx", "other", {"results": [{"url": "u", "content": "c"}]}), line("bing", "q", {"webPages": {"value": [{"name": "n", "url": "u", "snippet": "s"}] * 3}})]))
    rows = search.answers(spark, str(path), parts=3).cache()
    assert [r.title for r in search.hits(rows, "google", 1).collect()] == ["c"]
    assert [(r.href, r.body) for r in search.hits(rows, "semantic_scholar").collect()] == [("pdf", "ab")]
    t = search.hits(rows, "xquik").first()
    assert t.title == "@me: " + "x" * 120 + "..." and t.href == "https://x.com/me/status/7" and t.body.endswith("\n\n[2 likes, 1 RTs, 9 views]")
    assert search.hits(rows, "bing", 1).count() == 3 and search.hits(rows, "searx").first().title is None
    assert search.answers(spark, str(path), query="other").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "sub" / "b.HTML").write_text("<title>T</title><p>body</p><nav>x</nav>")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {(r.url, r.title, r.raw_content) for r in files.load(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", "", "hello"), ("b.HTML", "T", "T\nbody")}
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "c.bin"))
    pages = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a")], "url string, page_no int, text string")
    assert files.joined_pages(pages).first().raw_content == "a\nb"


def test_evaluation_sets_and_records(spark, tmp_path):
    import bz2

    lines = "\n".join(json.dumps({"interaction_id": f"i{i}", "split": i % 2, "search_results": [{"page_result": "<p>body text</p>" if i else "", "page_snippet": "short", "page_url": "u" if i else "", "page_name": None}]}) for i in range(3))
    (tmp_path / "c.jsonl.bz2").write_bytes(bz2.compress(lines.encode()))
    rows = files.evaluation(spark, str(tmp_path / "c.jsonl.bz2"), split=0)
    assert rows.count() == 2
    from tessera.functions.html import stripped

    got = {(r.interaction_id, r.url, r.title, r.raw_content) for r in files.crag_documents(rows, stripped(100)).collect()}
    assert got == {("i0", "doc_0", "Document 0", "short"), ("i2", "u", "Document 0", "body text")}
    (tmp_path / "q.csv").write_text("problem,answer\np,a\n")
    assert files.evaluation(spark, str(tmp_path / "q.csv")).first().answer == "a"
    records = spark.createDataFrame([("text", {"title": "T"})], "page_content string, metadata map<string,string>")
    assert tuple(files.from_records(records).first()) == ("T", "text")
    papers = spark.createDataFrame([("https://x.org/abs/12", "2020", "A", "S", "T")], "link string, published string, authors string, summary string, title string")
    assert tuple(files.papers(papers).first()) == ("12", "Published: 2020; Author: A; Content: S", "T")
    for _ in range(2):
        metrics.append_results(papers, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    ids = spark.createDataFrame([(1,), (2,)], "article_id int")
    articles = spark.createDataFrame([(1, "t"), (2, "")], "article_id int, body string")
    assert search.full_texts(ids, articles).count() == 1


def test_texts_of_reports(spark):
    lit = F.lit
    one = spark.range(1)
    made = one.select(reports.detailed(lit("i"), lit("t"), lit("b"), lit("c"), lit("r")).alias("x"), reports.report_file(lit("n" * 80)).alias("f")).first()
    assert made.x == "i\n\nt\n\nb\n\nc\n\nr" and made.f == "n" * 60 + ".md"
    sections = spark.createDataFrame([(0, "A"), (1, "B")], "pos int, header string")
    images = spark.createDataFrame([("A", "u1", 1), ("A", "u2", 2)], "header string, url string, seq int")
    assert {(r.header, r.image_url) for r in reports.section_images(sections, images).collect()} == {("A", "u2"), ("B", None)}
    asked = spark.createDataFrame([(2, "p"), (9, "q")], "section_number int, prompt string")
    assert [(r.header, r.prompt) for r in reports.suggested(sections, asked).collect()] == [("B", "p")]
    posted = reports.posted(spark.createDataFrame([("a", 50)], "id string, timestamp long"), spark.createDataFrame([("a", "40"), ("b", "soon")], "id string, timestamp string"), lit(99).cast("long"))
    assert {(r.id, r.timestamp) for r in posted.collect()} == {("a", 50), ("b", 99)}
    answers = spark.createDataFrame([("a", "- x", "u", 0)], "title string, body string, href string, pos int")
    assert research.quick_answers(answers).first().line == "[1] a: - x (u)"
    cited = research.with_citations(spark.createDataFrame([(0, "l"), (1, "m")], "pos int, learning string"), spark.createDataFrame([("l", "u", 1), ("l", "v", 2)], "learning string, url string, seq int"))
    assert [r.text for r in cited.orderBy("pos").collect()] == ["l [Source: v]", "m"]
    web = spark.createDataFrame([("w",)], "t string")
    assert {r.side for r in research.source_mode("hybrid", web, web).collect()} == {"web", "local"}
