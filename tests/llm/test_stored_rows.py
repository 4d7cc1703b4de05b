"""Rows that aren't stored one by one (explode, joins, unions, JSON, ORC) have keys of their own in every operator that needs some."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, jaccard, mixing, resampling, secrets, sharding
from tessera.llm.common import KEY, keyed, stored


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rows = [(i, " ".join(f"w{i * 7 + k}" for k in range(40 + i)), "en", "ab"[i % 2], None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    root = tmp_path_factory.mktemp("rows")
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(f"{root}/{kind}")
    return df.schema, root


def read(spark, files, kind):
    return spark.read.schema(files[0]).format(kind).load(f"{files[1]}/{kind}")


def shapes(spark, files):
    base = read(spark, files, "parquet")
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    return {
        "json": (read(spark, files, "json"), 1),
        "orc": (read(spark, files, "orc"), 1),
        "explode": (base.select("*", twice.alias("copy")).drop("copy"), 2),
        "union": (base.unionByName(base), 2),
        "join": (base.join(spark.range(2).withColumnRenamed("id", "copy")).drop("copy"), 2),
    }


def test_only_bare_scans_are_stored(spark, files):
    base = read(spark, files, "parquet")
    assert stored(base) and stored(base.where("doc_id > 3").select("text", F.upper("lang").alias("l")))
    assert not stored(base.limit(5)) and not stored(base.distinct()) and not stored(spark.range(3))
    for name, (df, times) in shapes(spark, files).items():
        keys = [tuple(r) for r in keyed(df).select(*KEY).collect()]
        assert not stored(df) and len(keys) == len(set(keys)) == 30 * times, name


@pytest.mark.parametrize("name", ["json", "explode"])  # the keys of the others are tested above
def test_operators_on_derived_rows(spark, files, name):
    df, times = shapes(spark, files)[name]
    words = sum(len(r.text.split()) for r in df.collect())
    mixed = sum(len(r.text.split()) for r in mixing.mix(df).collect())
    assert abs(mixed - sum(t for (t,) in mixing.mix_plan(df).select("taken").collect())) == 0 and abs(mixed - 1.5 * words) < 3
    assert jaccard.one_of_each(df).count() == 30
    assert Counter(r.doc_id for r in secrets.redact(df).collect()) == {i: times for i in range(30)}
    assert fingerprints.fingerprint(df).count() == 30 * times
    assert sorted(r.slot for r in sharding.reshard(df, F.lit(0), 1).collect()) == list(range(30 * times))
    assert resampling.resample(df, df.limit(1), percent=50).count() == 15 * times
