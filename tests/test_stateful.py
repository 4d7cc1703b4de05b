"""Visits across restarts, late and repeated; a ledger whose batches come twice; levels of a graph with a hub."""

import random

from pyspark.sql import functions as F

from tessera.operators import research
from tessera.streaming import stateful


def test_each_address_once_across_restarts(spark, tmp_path):
    schema = "url string, seq long, ts timestamp"
    ins, out, at = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    put = lambda rows: spark.createDataFrame(rows, "url string, seq long").withColumn("ts", F.timestamp_seconds(F.lit(10**9) - F.col("seq"))).coalesce(1).write.mode("append").parquet(ins)
    known = spark.createDataFrame([("old",), ("old",)], "url string")
    follow = lambda: stateful.run(stateful.visited_once(spark.readStream.schema(schema).parquet(ins), "seq", known), out, at)
    provider = spark.conf.get(stateful.PROVIDER[0])
    put([("a", 2), ("a", 1), ("b", 3), ("old", 4), (None, 9)])
    follow()
    put([("a", 5), ("c", 10**6), ("c", 10**6), ("old", 6)])  # very late, repeated
    follow()
    follow()
    rows = sorted((r.url or "", r.seq) for r in spark.read.schema(schema).parquet(out).collect())
    assert rows == [("", 9), ("a", 1), ("b", 3), ("c", 10**6)] and spark.conf.get(stateful.PROVIDER[0]) == provider


def test_ledger_counts_a_repeated_batch_once(spark, tmp_path):
    ledger = stateful.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    ledger.KEPT = 3
    batch = lambda k: spark.createDataFrame([("plan", 1.0), ("write", float(k))], "step string, cost double")
    for k in range(8):
        ledger.merge(batch(k), k)
        ledger.merge(batch(k), k)  # as after a failure before the commit
    got = {r.step: (r.cost, r.n) for r in ledger.totals().collect()}
    assert got == {"plan": (8.0, 8), "write": (28.0, 8)}
    assert len(ledger._numbers("upto")) == 1 and len(ledger._numbers("batch")) <= 4
    ledger.merge(batch(0), 0)  # below the snapshot
    assert {r.step: r.n for r in ledger.totals().collect()} == {"plan": 8, "write": 8}


def test_levels_are_least(spark):
    chance = random.Random(9)
    edges = [(f"n{chance.randint(0, 60)}", f"n{chance.randint(0, 60)}") for _ in range(90)] + [("n1", f"leaf{i}") for i in range(500)] + [("n2", None)]
    seeds = ["n0", "n1", "n1", None]
    want, front, level = {"n0": 0, "n1": 0}, {"n0", "n1"}, 0
    while front and level < 4:
        level += 1
        front = {b for a, b in edges if a in front and b is not None and b not in want}
        want |= dict.fromkeys(front, level)
    got = research.expanded(spark.createDataFrame([(s,) for s in seeds], "node string"), spark.createDataFrame(edges, "src string, dst string"), 4).collect()
    assert len(got) == len(want) and {r.node: r.level for r in got} == want
    assert research.expanded(spark.createDataFrame([], "node string"), spark.createDataFrame(edges, "src string, dst string"), 3).count() == 0
