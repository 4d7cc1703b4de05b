"""Functions of rows hold few rows at once, and are called once for each."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import arrow
from tessera.operators import chunking
from tessera.plans import queries
from tests.conftest import DATA


def test_results_leave_a_few_rows_at_a_time(spark):
    run = arrow.by_rows(lambda a, b: [a, str(b)], "array<string>", pa.list_(pa.string()))
    made = list(run.func(iter([(pa.array(["x"] * 1000), pa.array(range(1000)))])))
    assert max(len(m) for m in made) <= arrow.ROWS and sum(len(m) for m in made) == 1000
    assert made[0][0].as_py() == ["x", "0"] and made[-1][-1].as_py() == ["x", "999"]


def test_adaptive_chunks_pass_texts_to_python_once(spark, capfd):
    rows = spark.createDataFrame([(i, "u", "t", f"text {i}. " * 40) for i in range(300)], "doc_id long, url string, title string, raw_content string")
    made = chunking.adaptive_chunks(rows)
    made.explain()
    assert capfd.readouterr().out.count("ArrowEvalPython") == 1
    assert made.select("doc_id").distinct().count() == 300


def test_relevant_images_pass_pages_to_python_once(spark, capfd):
    made = queries.QUERIES["relevant_images"](spark, DATA)
    made.explain()
    assert capfd.readouterr().out.count("ArrowEvalPython") == 1


def test_adaptive_markdown_chunks_pass_texts_to_python_once(spark, capfd):
    made = queries.QUERIES["adaptive_markdown_chunks"](spark, DATA)
    made.explain()
    assert capfd.readouterr().out.count("ArrowEvalPython") == 1
