"""Postings counted in a chunk's own row, dealt to files by places."""

from pyspark.sql import functions as F

from tessera.plans import term_index


def test_words_are_counted_without_a_shuffle_of_postings(spark, capfd):
    rows = spark.createDataFrame([(1, 5, "b a b"), (1, 6, "x"), (2, 7, "c c c")], "bucket int, pos long, content string")
    made = term_index._counted(rows.select("bucket", "pos", F.sort_array(F.split("content", " ")).alias("w")))
    made.explain()
    assert "Exchange" not in capfd.readouterr().out
    assert sorted(tuple(r) for r in made.collect()) == [(1, 5, 3, "a", 1), (1, 5, 3, "b", 2), (1, 6, 1, "x", 1), (2, 7, 3, "c", 3)]
