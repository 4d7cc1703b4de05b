import hashlib
import random
from collections import Counter

from tessera.llm import hashing, repeats
from tests.llm.fixtures import SCHEMA, awkward, words


def brute(texts, k):
    counts = Counter(tuple(w[i : i + k]) for w in map(words, texts) for i in range(len(w) - k + 1))
    for t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if counts[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def rows_of(texts):
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def check(spark, rows, k, short):
    got = Counter(map(tuple, repeats.digests(repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), k, short)).collect()))
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], k), strict=True))


def test_awkward_rows(spark):
    check(spark, awkward(), repeats.K, repeats.SHORT)


def test_random_texts(spark):
    rng = random.Random(8)
    for k, short, letters in ((6, 2, "ab"), (9, 3, "abc"), (12, 4, "abcdefgh")):
        passage = [rng.choice(letters) for _ in range(40)]
        texts = []
        for _ in range(60):
            w = [rng.choice(letters) * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                a = rng.randrange(20)
                w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randint(k - 2, k + 14)]
            texts.append(" ".join(w))
        check(spark, rows_of(texts + texts[:3]), k, short)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 50)
    monkeypatch.setattr(hashing, "GROUP", 300)
    rng = random.Random(9)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    check(spark, rows_of([" ".join(base), " ".join(base[100:180] + ["x"] + base[250:300])]), 10, 3)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_one_pattern_differ(spark):
    """Two words of Thue-Morse letters, which a polynomial hash can't tell apart, make no repeats."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(0, f"{head} {word}"), (1, f"{head} {word.translate(str.maketrans('ab', 'ba'))}")], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(docs).collect()] == [0, 0]


def test_paths_are_compacted(spark):
    """Nonbranching nodes join pieces, branching ones and cycles part them."""
    rows = [(i, i, i, i + 1, 10) for i in range(100)]  # a chain of a hundred pieces, places 0 to 1000
    rows += [(200, 0, 500, 501, 3), (201, 0, 501, 502, 4), (202, 0, 501, 503, 5)]  # a fork
    rows += [(300, 0, 600, 601, 1), (301, 0, 601, 600, 1), (302, 0, 700, 700, 1)]  # cycles
    found = spark.createDataFrame(rows, "s1 long, s2 long, u long, v long, edges int")
    got = {(r.s1, r.s2): (r.p1, r.p2, r.offset) for r in repeats.compacted(found).collect()}
    want = {(i, i): (0, 0, 10 * i) for i in range(100)} | {(s, 0): (s, 0, 0) for s in (200, 201, 202, 300, 301, 302)}
    assert got == want


def test_spans_are_whole(spark):
    """A passage in two documents is one span on one path in both, whatever stands around it."""
    passage = " ".join(f"p{i}" for i in range(400))
    docs = spark.createDataFrame([(0, f"some words before {passage}"), (1, f"{passage} and others after it"), (2, "nothing of it")], "doc_id long, text string")
    rows = repeats.repeated_spans(docs).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in rows) == [(0, 3, 400), (1, 0, 400)] and len({(r.p1, r.p2, r.offset) for r in rows}) == 1
