from collections import Counter

import corpus_pipeline
from tessera.llm import quality, secrets, tokens
from tests.conftest import DATA
from tests.llm.test_jaccard import brute


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, and run() on the same rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, outs, kept = docs.columns, [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, DATA).write.parquet(f"file://{tmp_path}/{i}")
        kept = spark.read.parquet(f"file://{tmp_path}/{i}")
        outs.append(kept)
    assert all(o.columns == names for o in outs[:-1])

    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in outs[0].collect()} == good and len(good) > 0.6 * len(rows)

    passed = [(i, rows[i].text) for i in sorted(good)]
    components = brute(passed)
    assert sorted(r.doc_id for r in outs[1].collect()) == sorted(i for i, n, c in components if i == c)

    unique = outs[1]
    found = Counter((r.doc_id, r.candidate) for r in secrets.scan(unique).collect() if r.is_secret)
    for r in outs[2].collect():
        assert not any(c in r.text for i, c in found if i == r.doc_id)
    assert outs[2].count() == unique.count() and sum(r.text.count(secrets.MARK) for r in outs[2].collect()) == sum(found.values())

    sizes = Counter()
    for r in outs[2].collect():
        sizes[r.source] += len(r.text.split())
    mixed = Counter()
    for r in outs[3].collect():
        mixed[r.source] += len(r.text.split())
    assert abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(mixed[s] <= 2 * sizes[s] + 1 for s in sizes)

    encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    want = sum(len(encoder.text_ids(r.text.encode())) // 2 + 1 for r in outs[3].collect())
    packed = outs[4].collect()
    assert sum(r.length for r in packed) == want
    again = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in again) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
