import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import fingerprints, licenses, mixing, packing, quality, token_counts, tokens
from tests.llm.fixtures import SCHEMA, awkward, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def path():
    return tokens.tokenizer_path("word_bpe_49k.json")


def brute_quality(text):
    w, t = words(text), text or ""
    n, windows = len(w), [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark, odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(odd).collect())
    assert got == Counter((r[0], *brute_quality(r[1])) for r in awkward())
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_keeps_clean_and_drops_outliers(spark):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "en", "s", 1) for i in range(60)]
    junk = [(100 + i, " ".join(f"word{i}y{j}###" for j in range(80)), "en", "s", 1) for i in range(5)]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert kept == set(range(60))


def test_each_measure_acts(spark):
    """One text that stands out by each measure alone goes, however few or many junk texts its source has; the others stay."""
    plain = lambda i, n=80: [f"w{i:04d}x{j:02d}" for j in range(n)]
    clean = [(i, " ".join(plain(i)), "en", f"s{i % 2}", 1) for i in range(400)]
    odd = [" ".join(w + "#" for w in plain(1001)), " ".join([*plain(1002, 60), *plain(1002, 12)]), "\n".join([*plain(1003), "again", "again"]), " ".join(plain(1004)).upper(), " ".join(w * 5 for w in plain(1005))]
    docs = [*clean, *[(1000 + i, t, "en", "s0", 1) for i, t in enumerate(odd)]]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {i for i, r in rows.items() if r.kept} == set(range(400))
    measures = [rows[1000 + i].measures.asDict() for i in range(5)]
    usual = rows[0].measures.asDict()
    assert [[m for m in usual if got[m] > usual[m] + 100] for got in measures] == [["symbols"], ["repeats"], ["lines"], ["capitals"], ["length"]]


def test_licenses(spark, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def brute(text):
        w = word.findall((text or "").translate(lower))
        at = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))

    rows = licenses.scan_licenses(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter((r[0], *brute(r[1])) for r in awkward())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in rows)


def test_template_regions():
    a = licenses.Automaton("permission is [[hereby]] granted to {{who:1-3}} free")
    assert a.match(b"permission is granted to any body free of".split(), 0) == 7
    assert a.match(b"permission is hereby granted to all free".split(), 0) == 7
    assert not a.match(b"permission is really granted to all free".split(), 0)
    assert not a.match(b"permission is granted to one two three four free".split(), 0)


def test_token_counts(spark, odd, path, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = Counter()
    for r in awkward():
        t = r[1] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want[(r[0], len(t.encode()), n, n > 2048)] += 1
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds every count in the cache
        assert Counter(map(tuple, token_counts.count_tokens(odd, path, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.dropDuplicates(["digest"]).count() == 10
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_round_trip(spark, odd, path):
    import numpy as np

    encoder = tokens.WordEncoder(path)
    rows = packing.digests(packing.pack(odd, path)).collect()
    want = Counter()
    for r in awkward():
        want[(r[0], encoder.text_ids((r[1] or "").encode()) + b"\x02\x00")] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    full = sum(len(ids) // 2 for (_, ids), n in want.items() for _ in range(n))
    assert sum(r.length for r in rows) == full and len(by_sequence) == -(-full // 4096)
    for (doc, ids), n in want.items():
        words_ = np.frombuffer(ids, "<u2").astype("<u4")
        pieces = by_doc[(doc, len(words_))]
        assert all(zlib.crc32(words_[s : s + k].tobytes()) == c for s, k, c in pieces)
        assert sum(k for _, k, _ in pieces) == n * len(words_)
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_packing_mixes_every_window(spark, path):
    docs = [(i, "word " * 99, "en", "big" if i % 4 else "small", 1) for i in range(800)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), path, window=4096).select("source", "sequence_id", "length").collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r.sequence_id][r.source] += r.length
    whole = [c for s, c in by.items() if s < max(by)]
    assert whole and all(abs(c["small"] / 4096 - 0.25) < 0.06 for c in whole)


def test_mixing(spark, odd):
    rows = mixing.mix_plan(odd).collect()
    again = mixing.mix_plan(odd.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in rows) == Counter((r.doc_id, r.size, r.taken) for r in again)
    taken, size, target = Counter(), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    for (whole, goal), got in taken.items():
        assert abs(got - goal) <= 0.5 and goal <= 2 * whole
    sizes = [r[1] for r in awkward()]
    assert sum(t for (_, t) in taken) == pytest.approx(1.5 * sum(len(words(t)) for t in sizes))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_targets_stop_and_share_anew(spark):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40)], "source string, source_size long")).collect()}
    total, caps, weights = 1.5 * 1150, {"a": 20, "b": 200, "c": 2000, None: 80}, {"a": 3, "b": 1, "c": 2, None: 3}
    goal, open_ = {}, set(caps)
    while open_:
        rest = total - sum(goal.values())
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > caps[s]}
        goal |= {s: caps[s] for s in full} if full else {s: level * weights[s] for s in open_}
        open_ -= full or open_
    assert got == pytest.approx(goal)


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def prints(fingerprint):
    text = fingerprint.partition(":")[2]
    return {text[i : i + 16] for i in range(0, len(text), 16)}


def test_fingerprints(spark):
    rows = [r for i, r in enumerate(awkward()) if i != 2]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for r, nxt in brute_next(rows):
        t, after, g = r[1] or "", nxt[1] or "", got[r[0]]
        n = len(t)
        edited = t[: n - n // 4] + after[: n // 4]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest()), r[0]
        own, changed, other = (prints(x) for x in (g.fingerprint, g.edited_fingerprint, got[nxt[0]].fingerprint))
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (g.near_edited, g.near_next) == (alike(own, changed), alike(own, other)), r[0]
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1
    assert fingerprints.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_are_whole_and_continuous(spark):
    import random

    from pyspark.sql import functions as F

    sets = lambda texts: [set(r.s) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(fingerprints.signatures(F.col("text")).alias("s")).collect()]
    rng = random.Random(6)
    for n_anchors in range(3, 12):
        w = [f"w{rng.randrange(9999)}" for _ in range(560)]
        for i in rng.sample(range(540), n_anchors):
            w[i] = "the"
        whole, edited = sets([" ".join(w), " ".join(w[:420] + [f"z{i}" for i in range(140)])])
        assert len(whole) > 400
        assert 0.55 < len(whole & edited) / len(whole | edited) < 0.65, n_anchors
    w = [rng.choice(["the", "of", *(f"w{k}" for k in range(50))]) for _ in range(70)]
    anchors = [i for i, x in enumerate(w) if x in ("the", "of")]
    content = lambda i: ([x for x in w[i + 1 :] if x not in ("the", "of")] + ["", ""])[:2]
    want = {(w[i], *content(i)) for i in anchors} | {(w[i], (w + [""])[i + 1]) for i in range(70) if not {"the", "of"} & set(w[max(0, i - 2) : i + 1])}
    got, anchors_only, signs, empty = sets([" ".join(w), "the of", "###", ""])
    assert len(got) == len(want) and anchors_only and len(signs) == 1 and not empty
    literal = [(F.xxhash64(*[F.lit(x) for x in k])) for k in want]
    assert got == set(spark.range(1).select(F.array(*literal).alias("s")).first().s)


def test_near_classes(spark):
    import random

    rng = random.Random(2)
    bases = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(5000)}"]) for _ in range(n)) for n in (60, 200, 400)]
    rows = []
    for i in range(60):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 1, 2, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "###", "en", "s", 0), (103, "###", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {}
    for r in fingerprints.fingerprint(docs).collect():
        sets[r.doc_id] = prints(r.fingerprint)
    parent = {i: i for i in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_signatures, r.class_id) for r in fingerprints.near_classes(docs).collect()}
    assert got == {i: (len(s), top(i)) for i, s in sets.items()}
    assert {r.doc_id: r.class_id for r in fingerprints.fingerprint(docs, classes=True).collect()} == {i: top(i) for i in sets}
    assert fingerprints.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_classes_move_few_texts(spark):
    """Where a join is not broadcast, no stage writes all texts to shuffle files: only those that the first pass leaves."""
    import random

    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(1600):x}" for _ in range(40)) for _ in range(400)]
    texts[399] = texts[0] + " tail"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    store, most = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    none, no_quantiles = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for found in [store.stageList(none, False, False, no_quantiles, none)] for i in range(found.size()))}
    before = set(stages())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.class_id for r in fingerprints.near_classes(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == {i: 0 if i == 399 else i for i in range(400)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    written = {i: n for i, n in stages().items() if i not in before}
    assert 0 < max(written.values()) < 0.2 * sum(map(len, texts)), written


def test_sieve_loses_no_key(spark):
    from tessera.llm.common import sieved

    rows = spark.range(20_000).selectExpr("id - 5000 as a", "id % 7 as b", "concat('t', id) as text")
    keys = rows.where("a % 50 = 0").select("a", "b")
    left = [r.a for r in sieved(rows, keys.unionByName(keys), ["a", "b"]).collect()]
    assert len(left) == len(set(left)) < 500 and {a for a in range(-5000, 15_000) if a % 50 == 0} <= set(left)
    assert sieved(rows, keys.limit(0), ["a", "b"]).count() == 0 and sieved(rows.limit(0), keys, ["a", "b"]).columns == ["a", "b", "text"]


def test_repeats_beside_clashing_hashes(spark):
    """Two windows whose hashes agree in their upper 40 bits stand between repeats of one of them."""
    fill = lambda s, n: " ".join(f"{s}{i}" for i in range(n))
    texts = [" ".join(["a b w3205730", fill("p", 5), "a b w3107512", fill("q", 5), f"a b {last}", fill("z", 3)]) for last in ("w3205730", "w3205731", "w3107512")]
    rows = quality.judge(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {0: 6, 1: 0, 2: 6} == {i: brute_quality(t)[4] for i, t in enumerate(texts)}


def test_templates_of_any_kind():
    scan = licenses.Scanner(licenses.PHRASES, {"grant": "permission is hereby granted [[free of charge]]", "open": "{{who:1-2}} may copy this"}).scan
    assert scan(b"Permission is hereby granted, free of charge. Anyone may copy this")[2] == [(0, 7, "grant"), (6, 5, "open")]
    assert scan(b"you can copy this")[2] == []
    n = 40_000
    assert licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan(b"mit license " * n)[1][-1] == (2 * n - 2, "mit")


def test_empty_share(spark, path):
    docs = spark.createDataFrame([(i, "one two three", "en", "ab"[i % 2], 13) for i in range(20)], SCHEMA)
    shares = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "source string, share double")
    rows = packing.pack(docs, path, length=16, shares=shares).collect()
    places = {s: [r.sequence_id * 16 + r.offset for r in rows if r.source == s] for s in "ab"}
    assert {r.doc_id for r in rows} == set(range(20)) and max(places["b"]) < min(places["a"])
