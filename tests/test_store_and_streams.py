import json

from pyspark.sql import functions as F

from tessera.functions.vector import digest_embedding
from tessera.operators import chunking, ranking
from tessera.plans.pipeline import Pipeline, QuestionTool, Settings
from tessera.plans.store import ChunkStore
from tessera.plans.term_index import TermIndex
from tessera.streaming import events as streams


def made(spark, prefix, n, source="s"):
    rows = [(f"{prefix} content {i} about plain things", f"{source}{i % 2}", f"Doc {i}", i) for i in range(n)]
    return spark.createDataFrame(rows, "content string, source string, title string, chunk_index int")


def test_store_lifecycle(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = ChunkStore(spark, path, digest_embedding)
    q = spark.createDataFrame([(0, "content about things")], "query_id long, query string")
    assert store.count() == 0 and store.retrieve(q).count() == 0 and store.delete("x") == 0
    assert store.add(made(spark, "old", 4)) == 4 and store.count() == 4
    assert store.add(made(spark, "new", 6)) == 6 and store.count() == 6  # both sources are replaced
    assert store.add(made(spark, "free", 2).withColumn("source", F.lit(""))) == 2 and store.add(made(spark, "free", 2).withColumn("source", F.lit(""))) == 2
    assert store.count() == 10
    assert [(r.source, r.n_chunks) for r in store.sources().collect()] == [("s0", 3), ("s1", 3), ("", 4)]
    assert store.delete("s0") == 3 and store.count() == 7
    again = ChunkStore(spark, path, digest_embedding)
    assert again.count() == 7
    hits = again.retrieve(q, 3).collect()
    assert len(hits) == 3 and all(h.hybrid_score > 0 for h in hits)
    assert again.similar(q, 2, {"source": "s1"}).count() == 2


def test_an_upsert_leaves_other_files_alone(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", digest_embedding, buckets=16)
    rows = spark.range(400).select(F.concat(F.lit("text "), "id").alias("content"), F.concat(F.lit("s"), F.col("id") % 40).alias("source"), F.lit("T").alias("title"), F.lit(0).alias("chunk_index"))
    assert store.add(rows) == 400
    stamps = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before, bucket = stamps(), store._stored().where("source = 's7'").first().bucket
    assert store.add(rows.where("source = 's7'").limit(3)) == 3 and store.count() == 393
    after = stamps()
    assert {p for p in before if f"bucket={bucket}/" not in p} == {p for p in after if f"bucket={bucket}/" not in p}
    assert all(after[p] == before[p] for p in after if f"bucket={bucket}/" not in p)
    assert not {p for p in before if f"bucket={bucket}/" in p} & set(after)
    assert store.delete("s7") == 3 and store.chunks().where("source = 's7'").count() == 0 and store.index.stats().first().n == 390


def test_term_index_equals_bm25_and_skips_blocks(spark, tmp_path):
    common = [(i % 8, i, f"fox lake {'hill ' * (i % 5)}road") for i in range(400)]
    rare = [(3, 1000 + i, "fox comet " + "comet " * i) for i in range(6)] + [(5, 2000, "comet " + "road " * 30)]
    chunks = spark.createDataFrame(common + rare, "bucket int, pos long, content string")
    index = TermIndex(spark, f"file://{tmp_path}/index")
    index.write(chunks.where("pos < 2000"))
    index.write(chunks.where("pos = 2000").withColumn("bucket", F.lit(9)))  # a later block
    q = spark.createDataFrame([(0, "comet fox")], "query_id long, query string")
    rows = lambda df: {(r.query_id, r.pos): round(r.bm25_score, 9) for r in df.collect()}
    whole = ranking.bm25(q, chunks, "pos")
    assert rows(index.scores(q)) == rows(whole) and index.read_blocks == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert rows(index.topk(q, 5)) == rows(ranking.ranked(whole, "bm25_score", "rank", most=5)) and index.read_blocks == [3, 9]
    more = spark.createDataFrame([(1, "lake hill"), (2, "none"), (3, "road road comet")], "query_id long, query string")
    assert rows(index.topk(more, 7)) == rows(ranking.ranked(ranking.bm25(more, chunks, "pos"), "bm25_score", "rank", most=7))
    assert any("bucket" in x.split("]")[0] for x in _plan(index.scores(q)).split("PartitionFilters: [")[1:])


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_retrieve_equals_whole_lists(spark, tmp_path):
    rows = [(f"{'fox ' * (i % 4)}{'lake ' * (i % 3)}word{i % 7} text {i % 50}", f"s{i % 9}", "T", i) for i in range(200)]
    store = ChunkStore(spark, f"file://{tmp_path}/store", digest_embedding)
    store.add(spark.createDataFrame(rows, "content string, source string, title string, chunk_index int"))
    q = spark.createDataFrame([(0, "fox word3"), (1, "absent"), (2, "lake lake text")], "query_id long, query string")
    asked, chunks = q.withColumn("embedding", digest_embedding(F.col("query"))), store.chunks()
    near = ranking.ranked(ranking.vector_scores(asked, chunks, "pos").withColumn("vector_score", F.round("vector_score", 9)), "vector_score", "vector_rank", most=15)
    words = ranking.ranked(ranking.bm25(asked, chunks, "pos").withColumn("bm25_score", F.round("bm25_score", 9)), "bm25_score", "bm25_rank")
    want = ranking.ranked(ranking.fused_candidates(words, near, "pos"), "hybrid_score", "rank", most=5)
    key = lambda df: sorted((r.query_id, r["rank"], r.pos, round(r.hybrid_score, 9)) for r in df.collect())
    assert key(store.retrieve(q, 5)) == key(want)


def test_places_follow_the_ids_and_copies_tie_by_them(spark, tmp_path):
    """Files that are read in another order than their ids go."""
    rows = [(i, "u", "T", "fox lake " * 30 if i % 3 else f"hen {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, raw_content string").repartition(7, "raw_content", "doc_id")
    store = ChunkStore(spark, f"file://{tmp_path}/loaded", digest_embedding)
    store.load(docs)
    assert [r.content for r in store.chunks().orderBy("pos").select("content").collect()] == [r[3].strip() for r in rows]
    added = ChunkStore(spark, f"file://{tmp_path}/added", digest_embedding)
    added.add(docs.select(F.col("raw_content").alias("content"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source"), "title", F.lit(0).alias("chunk_index"), "doc_id"), order="doc_id")
    found = added.retrieve(spark.createDataFrame([(0, "fox")], "query_id long, query string"), 6).orderBy("rank").collect()
    assert [r.bm25_rank for r in found if r.bm25_score > 0] and [r.source for r in sorted(found, key=lambda r: r.pos)] == sorted((r.source for r in found), key=lambda x: int(x[1:]))
    ranks = sorted((r.bm25_rank, int(r.source[1:])) for r in found if r.bm25_rank is not None and r.bm25_rank < 6)
    assert ranks == [(n, i) for n, i in enumerate([1, 2, 4, 5, 7, 8]) if (n, i) in ranks] and ranks


def test_ingest(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# A\nfirst part\n## B\nsecond part")
    store = ChunkStore(spark, f"file://{tmp_path}/store", digest_embedding)
    assert store.ingest(str(tmp_path / "docs")) == 2 and {r.source for r in store.chunks().collect()} == {"a.md"}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.bin").write_text("x")
    assert store.ingest(str(tmp_path / "none")) == 0


def test_pipeline_modes(spark, tmp_path):
    docs = spark.createDataFrame([(0, "http://a", "A", "Memory text about foxes. " * 40), (1, "http://b", "B", "Other text about hens. " * 40)], "doc_id long, url string, title string, raw_content string")
    q = spark.createDataFrame([(0, "foxes"), (1, "hens")], "query_id long, query string")
    model = lambda c: F.concat(F.lit("- more "), c)
    for strategy in ("semantic", "adaptive", "fixed"):
        rows = Pipeline(Settings(chunking_strategy=strategy), digest_embedding, model).process(q, docs).collect()
        assert len(rows) == 2 and all("Source: http://" in r.context for r in rows)
    empty = Pipeline(Settings(), digest_embedding).process(q, docs.limit(0)).collect()
    assert [r.context for r in empty] == ["", ""]
    store = ChunkStore(spark, f"file://{tmp_path}/store", digest_embedding)
    store.add(made(spark, "stored", 3, "kb"))
    primary = Pipeline(Settings(chunking_strategy="fixed", knowledge_store_mode="primary"), digest_embedding, store=store).process(q, docs).collect()
    assert all("http://" not in r.context and "kb" in r.context for r in primary)
    both = Pipeline(Settings(chunking_strategy="fixed"), digest_embedding, store=store).process(q, docs).collect()
    assert all("kb" in r.context and "http://" in r.context for r in both)
    answer = QuestionTool(Pipeline(Settings(), digest_embedding, model, store)).query(q).collect()
    assert all(len(r.chunks) == 3 and [s.source for s in r.sources] for r in answer)
    assert QuestionTool(Pipeline(Settings(), digest_embedding, store=store)).search(q, 2).count() == 4
    auto = Pipeline(Settings(chunking_strategy="fixed", query_rewrite_strategy="auto"), digest_embedding, model).process(q, docs)
    assert auto.count() == 2


def test_event_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"run_id": "r", "seq": i, "ts": f"2024-01-01T00:{i:02d}:00Z", "type": t, "data": d} for i, (t, d) in enumerate([("logs", "a"), ("query", "b"), ("query", "c"), ("report", "d")])]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    log, progress = streams.log_source(spark, str(folder)), streams.Progress()
    spark.streams.addListener(progress)
    streams.append(log, str(tmp_path / "log"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(progress)
    assert progress.rows == 4
    streams.content_state(log).writeStream.format("memory").queryName("state").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.value) for r in spark.table("state").collect()} == {("query", "c"), ("report", "d")}
    visits = log.select("ts", F.lit("u").alias("url"))
    streams.first_visits(visits).writeStream.format("memory").queryName("visits").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("visits").count() == 1
    windows = streams.tumbling(log.select("ts", F.col("type").alias("event_type"), F.lit(1.0).alias("value")))
    windows.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").columns == ["window_start", "event_type", "n", "total"]


def test_documents_helper(spark):
    df = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string")
    assert chunking.documents(df).first().url == ""
