import random
from collections import Counter

import pytest

from tessera.llm import jaccard
from tests.llm.fixtures import SCHEMA, awkward, words


def brute(rows, k=5, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return Counter((r[0], len(sets[i]), least.get(top(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def got(spark, rows, **options):
    df = jaccard.linked_sets(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return Counter(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_awkward_rows(spark):
    assert got(spark, awkward()) == brute(awkward())


@pytest.mark.parametrize("frequent", [1, 4, 32])
def test_families(spark, frequent):
    rng = random.Random(frequent)
    rows, bases = [], []
    for _ in range(6):
        bases.append([f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 9, 30, 80, 200]))])
    hot = [f"h{i}" for i in range(40)]
    for i in range(220):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(50)}"]
        if rng.random() < 0.3:
            w = hot[: rng.randint(10, 40)] + w[: rng.randint(1, len(w))]
        rows.append((i, " ".join(w), "en", "s", 0))
    assert got(spark, rows, frequent=frequent) == brute(rows)


def test_one_of_each(spark):
    rows = awkward()
    kept = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [0, 2, 3, 4, 5, 6, 7, 8, 10, 11] and len(ids) == 11
    assert jaccard.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    from tessera.llm.common import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(45)] + [(300, 200 + i) for i in range(30)] + [(7, 7), (400, 401), (401, 400)]
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in parent if top(i) != i}
