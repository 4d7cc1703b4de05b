from pyspark.sql import functions as F

import random

from tessera.functions import html, markdown

PAGE = """<html><head><title>A page</title><style>x</style></head><body><nav>menu</nav><div class="big sidebar"><p>side</p></div>
<h1>Top</h1><p>first <b>bold</b></p>text<h2>Next</h2><p>second</p><div><h3>Inner</h3><p>deep</p></div>
<img src="/a.png" class="hero"><img src="b.png" width="1700px" height="10"><img src="c.png" width="10" height="10"><img src="data:x"><img src="d.png">
<img src="e.png" width="2000" height="1000.5"><img src="f.png" width="800" height="1"><img src="g.png" width="500" height="1">
<a href="/x">link</a><a>none</a><script>var a;</script></body></html>"""


def test_page(spark):
    r = spark.range(1).select(html.page(F.lit(PAGE), F.lit("http://s.org/d/i.html")).alias("p")).first()["p"]
    assert r["title"] == "A page" and "menu" not in r["text"] and "side" not in r["text"] and "var a" not in r["text"]
    assert r["text"].startswith("A page\nTop\nfirst\nbold\ntext\nNext")
    assert [(i["url"].rsplit("/", 1)[1], i["score"]) for i in r["images"]] == [("a.png", 4), ("e.png", 3), ("b.png", 2), ("f.png", 1), ("d.png", 0), ("g.png", 0)]
    assert [(x["text"], x["href"]) for x in r["links"]] == [("link", "http://s.org/x")]


def test_heading_sections():
    got = html.heading_sections(html.parse(PAGE))
    assert got == ["Top first bold text", "Next second Inner deep link none var a;", "Inner deep"] or got[0] == "Top first bold text" and got[-1] == "Inner deep"


def test_small_html(spark):
    assert [html.dimension(x) for x in ("10px", "409.12", "x", None)] == [10, 409, None, None]
    rows = spark.createDataFrame([("http://a.org/p/x.png?url=http%3A%2F%2Fb.org%2Fq",), ("http://c.org/x.png",), ("http://d.org/y/x.png",)], "u string").select(html.image_hash("u").alias("h")).collect()
    assert rows[0].h != rows[1].h == rows[2].h
    assert spark.range(1).select(html.stripped(10)(F.lit("<p>ab</p><p>cd</p>")).alias("s")).first()["s"] == "ab cd"


MD = "lead\n# A\none\n## B\ntwo <b>x</b>\n### C\n\n## D\nfour\n# E\nfive"


def test_markdown(spark):
    df = spark.createDataFrame([(1, MD), (2, "plain")], "doc_id long, text string")
    rows = sorted((r.pos, r.level, r.text, r.parent_pos, r.depth) for r in markdown.headers(df).collect())
    assert rows == [(1, 1, "A", None, 0), (3, 2, "B", 1, 1), (5, 3, "C", 3, 2), (7, 2, "D", 1, 1), (9, 1, "E", None, 0)]
    assert [(r.section_title, r.written_content) for r in markdown.sections(df).orderBy("number").collect()] == [("A", "one"), ("B", "two x"), ("D", "four"), ("E", "five")]
    toc = {r.doc_id: r.toc for r in markdown.contents(df).collect()}
    assert toc == {1: "## Table of Contents\n\n- A\n    - B\n        - C\n    - D\n- E\n", 2: "## Table of Contents\n\n"}
    assert [(r.header, r.content, r.start_line, r.end_line) for r in markdown.line_sections(df).orderBy("start_line").collect()] == [("B", "two <b>x</b>", 3, 4), ("C", "", 5, 6), ("D", "four\n# E\nfive", 7, 10)]
    got = df.where("doc_id = 1").select(markdown.with_image(F.col("text"), F.lit("B"), F.lit("u$1"), F.lit("alt")).alias("t")).first()["t"]
    assert "## B\n\n![alt](u$1)\n\ntwo" in got or "## B\n\n![alt](u$1)\n" in got
    assert df.select(markdown.with_references(F.lit("r"), F.array(F.lit("u"))).alias("t")).first()["t"] == "r\n\n\n## References\n\n- [u](u)\n"


def test_markdown_rows_of_one_key_and_many_headers(spark):
    two = spark.createDataFrame([(1, "# a"), (1, "# b"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.toc) for r in markdown.contents(two).collect()) == [(1, "## Table of Contents\n\n- a\n"), (1, "## Table of Contents\n\n- b\n"), (2, "## Table of Contents\n\n"), (3, "## Table of Contents\n\n")]
    assert markdown.line_sections(spark.createDataFrame([(1, "## a\nx"), (1, "## a\ny")], "doc_id long, text string")).count() == 2
    chance = random.Random(1)
    levels = [chance.randint(1, 6) for _ in range(6000)]
    want, stack = [], []
    for pos, level in enumerate(levels):
        stack = [x for x in stack if x[1] < level]
        want.append((pos, stack[-1][0] if stack else None, len(stack)))
        stack.append((pos, level))
    long_ = spark.createDataFrame([(1, "\n".join("#" * n + f" h{i}" for i, n in enumerate(levels)))], "doc_id long, text string")
    assert sorted((r.pos, r.parent_pos, r.depth) for r in markdown.headers(long_).collect()) == want


def test_unclosed_elements_nest_deeper_than_calls_may(spark):
    n = 20_000
    deep = "<html><body>" + "<p>" * n + "deep" + "<nav>menu</nav>" + "<div class='footer x'>foot</div>end"
    row = spark.createDataFrame([(1, "http://a.b/c", deep)], "page_id long, url string, html string").withColumn("p", html.page(F.col("html"), F.col("url"))).first()["p"]
    assert row.text == "deep\nend"


def test_stripped_text_is_cut_as_asked(spark):
    df = spark.createDataFrame([("<p>abc</p>def<b>ghi</b>",), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(html.stripped(6)("html")).collect()] == ["abc de", "", ""]


def test_many_headings_and_strange_end_tags_take_time_in_proportion():
    n = 20_000
    assert html.heading_sections(html.parse("<p>" * n + "</x>" * n + "<h2>a</h2>b" * n)) == ["a b"] * n


def test_end_tags_close_what_is_open():
    root = html.parse("<div><p>a<b>c</div>d</p>e<br/></br><p>f")
    assert [c if isinstance(c, str) else c.name for c in root.children] == ["div", "d", "e", "br", "p"]
