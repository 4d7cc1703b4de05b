import random

import numpy as np
import pytest

from tessera.llm import scoring
from tessera.llm.hashing import word_hashes
from tests.llm.fixtures import SCHEMA, awkward, words


def test_against_a_loop(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    vocabulary = scoring.vocabulary(docs)
    network = scoring.train(docs, vocabulary, rounds=1, fraction=1)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.log_likelihood) for r in scoring.score(docs, vocabulary, network).collect())
    want = []
    for r in awkward():
        _, _, hashes, _ = next(word_hashes([(r[1] or "").encode()], lower=True))
        ids, inside = vocabulary.tokens(hashes)
        total = 0.0
        for i in range(min(len(ids), 40_000)):
            h = network.first_bias.astype(float).copy()
            for j, shift in enumerate((-2, -1, 1, 2)):
                h += network.first[j][ids[i + shift] if 0 <= i + shift < len(ids) else scoring.SIZE - 1]
            z = np.tanh(h) @ network.second + network.second_bias
            total += z[ids[i]] - z.max() - np.log(np.exp(z - z.max()).sum()) + inside[i]
        want.append((r[0] is None, r[0] or 0, len(words(r[1])), total))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-3, abs=1e-2)
    assert scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_real_order_scores_above_shuffled(spark):
    rng = random.Random(4)
    subjects, verbs, things = ["cat", "dog", "fox", "owl"], ["sees", "likes", "eats"], ["fish", "corn", "rain", "snow"]
    sentence = lambda: f"the {rng.choice(subjects)} {rng.choice(verbs)} a {rng.choice(things)} today"
    train = [(i, " ".join(sentence() for _ in range(30)), "en", "s", 0) for i in range(150)]
    held = [" ".join(sentence() for _ in range(20)) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    docs = spark.createDataFrame(train, SCHEMA)
    vocabulary = scoring.vocabulary(docs)
    network = scoring.train(docs, vocabulary, rounds=6, fraction=1)
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(held + mixed)], SCHEMA)
    means = [r["mean"] for r in sorted(scoring.score(rows, vocabulary, network).collect())]
    assert np.mean(means[:20]) > np.mean(means[20:]) + 0.3
    assert sum(a > b for a, b in zip(means[:20], means[20:], strict=True)) >= 19


def test_default_trains_on_every_document(spark):
    """Small tables of any texts are learnt from, and their weights are those of a pass over all of them."""
    for n in (1, 3, 20):
        docs = spark.createDataFrame([(i, f"red fox {i} sees the blue owl " * 6, "en", "s", 0) for i in range(n)], SCHEMA)
        vocabulary = scoring.vocabulary(docs)
        network = scoring.train(docs, vocabulary)
        assert not np.allclose(network.second, scoring.Network().second)
        untrained = [r["mean"] for r in scoring.score(docs, vocabulary, scoring.Network()).collect()]
        assert np.mean([r["mean"] for r in scoring.score(docs).collect()]) > np.mean(untrained) + 0.5
    texts = [f"word{i} stands by thing{i} and the other" for i in range(5)]
    table = lambda t: spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(t)], SCHEMA)
    vocabulary = scoring.vocabulary(table(texts))
    whole = scoring.train(table(texts), vocabulary, rounds=1)
    for i in range(5):
        other = scoring.train(table([*texts[:i], "quite another text", *texts[i + 1 :]]), vocabulary, rounds=1)
        assert not np.array_equal(whole.second, other.second)


def test_vocabulary_grows(spark):
    assert scoring.sizes(1000) == (scoring.FREQUENT, scoring.CELLS)
    small, large = scoring.sizes(80_000_000), scoring.sizes(5_000_000_000)
    assert scoring.FREQUENT < small[0] < large[0] and small[1] < large[1]
    words_ = np.arange(300, dtype=np.int64) * 7919
    vocabulary = scoring.Vocabulary(words_.tolist(), np.ones(scoring.CELLS, np.int64))
    ids, _ = vocabulary.tokens(words_.view(np.uint64))
    assert len(set(ids.tolist())) == 300 and ids.max() == vocabulary.size - 1 and scoring.SIZE - 1 not in ids
