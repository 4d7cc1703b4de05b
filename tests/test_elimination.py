import numpy as np
import pandas as pd
import pytest

from tessera.operators import elimination

SCHEMA = "query_id long, pos long, embedding array<double>, sort_score double, `a.b` string"


def kept_by_fold(rows, threshold):
    """The rule itself, row by row."""
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        v = np.array([r[2] for r in own])
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        near, kept = v @ v.T > threshold, [True] * len(own)
        for i in range(len(own)):
            for j in range(i + 1, len(own)) if kept[i] else ():
                if kept[j] and near[i, j]:
                    if own[j][3] > own[i][3]:
                        kept[i] = False
                        break
                    kept[j] = False
        out |= {(g, r[1]) for r, k in zip(own, kept, strict=True) if k}
    return out


def drawn(seed, groups, copies):
    """Vectors about centres, with copies next to each other and far apart, scores with ties, and zero vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(groups):
        centres = rng.normal(size=(max(2, n // 6), 5))
        v = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.25, size=(n, 5))
        for _ in range(copies):
            i, m = rng.integers(0, n), rng.integers(2, 9)
            v[i : i + m] = v[rng.integers(0, n)]
        v[rng.integers(0, n)] = 0
        rows += [(g, p, v[p].tolist(), float(s), "x") for p, s in enumerate(rng.integers(0, 6, n))]
    return rows


@pytest.mark.parametrize(("first", "fold"), [(elimination.FIRST, elimination.FOLD), (16, 0), (elimination.FIRST, 40)])
def test_equals_the_fold(spark, first, fold):
    rows = drawn(first + fold, (70, 9, 1, 45), 6)
    got = elimination.survivors(spark.createDataFrame(rows, SCHEMA), 0.8, first=first, fold=fold)
    assert got.columns == ["query_id", "pos", "embedding", "sort_score", "a.b"]
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(rows, 0.8)


def test_odd_rows(spark):
    rows = [(None, 0, [1.0, 0.0], 0.1, None), (None, 1, [2.0, 0.0], 0.1, None), (None, 2, None, 0.1, None), (None, 3, [1.0], 0.1, None), (None, 4, [], None, None), (0, 0, [1.0, 0.0], None, None), (0, 1, [1.0, 0.0], 0.5, None), (0, 2, [0.0, 0.0], 0.5, None)]
    got = elimination.survivors(spark.createDataFrame(rows, SCHEMA), 0.9)
    assert sorted((r.query_id is None, r.pos) for r in got.collect()) == [(False, 0), (False, 2), (True, 0), (True, 2), (True, 3), (True, 4)]
    assert elimination.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_run_of_copies_makes_no_pairs(spark, monkeypatch):
    """3,000 copies side by side, their scores rising and falling, end as one row before anything is paired."""
    seen = []
    whole = elimination._edges
    monkeypatch.setattr(elimination, "_edges", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = [(0, p, [1.0, 2.0], float(1500 - abs(p - 1500)), "x") for p in range(3000)] + [(0, 3000, [1.0, 2.1], 9999.0, "x")]
    got = elimination.survivors(spark.createDataFrame(rows, SCHEMA), 0.9)
    assert [r.pos for r in got.collect()] == [3000]
    assert sum(e.count() for e in seen) < 20


def test_a_group_of_100_000_rows(spark):
    """A third of the rows about one centre, the others about 3,000; the rule by numpy, a row at a time."""
    n, rng = 100_000, np.random.default_rng(5)
    centres = rng.normal(size=(3000, 16))
    v = centres[np.where(rng.random(n) < 0.33, 0, rng.integers(0, 3000, n))] + rng.normal(scale=0.12, size=(n, 16))
    v[::7] = centres[0]
    score = rng.integers(0, 1000, n).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"query_id": 0, "pos": np.arange(n), "embedding": list(v), "sort_score": score}))
    got = elimination.survivors(rows, 0.85).select("pos").collect()
    u, kept = v / np.linalg.norm(v, axis=1, keepdims=True), np.ones(n, bool)
    for i in range(n):
        if kept[i]:
            near = np.flatnonzero((u[i + 1 :] @ u[i] > 0.85) & kept[i + 1 :]) + i + 1
            higher = np.flatnonzero(score[near] > score[i])
            kept[i] = not len(higher)
            kept[near[: higher[0]] if len(higher) else near] = False
    assert sorted(r.pos for r in got) == np.flatnonzero(kept).tolist()


def test_small_groups_take_no_part_in_rounds(spark, monkeypatch):
    """Groups of a few rows, odd vectors among them, are folded as arrays; only a larger one is numbered and paired."""
    rounds = []
    whole = elimination._gone
    monkeypatch.setattr(elimination, "_gone", lambda rows, *a: rounds.append(rows) or whole(rows, *a))
    rows = drawn(3, (20,) * 30, 3)
    odd = [(90, 0, [1.0, 0.0], None, "x"), (90, 1, [1.0, 0.0], 0.5, "x"), (90, 2, [2.0, 0.0], 0.5, "x"), (90, 3, [1.0], 0.5, "x"), (90, 4, None, 0.5, "x"), (90, 5, [], 0.5, "x"), (90, 6, [float("nan"), 1.0], 0.5, "x")]
    got = elimination.survivors(spark.createDataFrame(rows + odd, SCHEMA), 0.8)
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(rows, 0.8) | {(90, p) for p in (0, 3, 4, 5, 6)} and not rounds
    more = rows + [(40, *r[1:]) for r in drawn(4, (80,), 3)]
    got = elimination.survivors(spark.createDataFrame(more, SCHEMA), 0.8)
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(more, 0.8) and rounds[0].select("_c0").distinct().count() == 1


def test_copies_leave_no_prefixes_to_play(spark, monkeypatch):
    """Rows of 13 vectors, one after another: a first prefix ends nearly all, few pairs are made, and no later prefix is played for nothing."""
    seen = []
    whole = elimination._edges
    monkeypatch.setattr(elimination, "_edges", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = [(0, p, [float(i == p * 7 % 13) for i in range(13)], float(p % 5), "x") for p in range(6000)]
    got = elimination.survivors(spark.createDataFrame(rows, SCHEMA), 0.85)
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(rows, 0.85)
    assert len(seen) <= 3 and sum(e.count() for e in seen) < 10 * 6000


def test_a_threshold_beyond_all_cosines_pairs_nothing(spark, monkeypatch):
    monkeypatch.setattr(elimination, "_edges", lambda *a: pytest.fail("pairs"))
    rows = spark.createDataFrame([(0, p, [float(p), 1.0], 0.0, "x") for p in range(3000)], SCHEMA)
    assert elimination.survivors(rows, 2.0).count() == 3000


def test_copies_with_rising_scores_make_no_pairs(spark, monkeypatch):
    """Each row of a class ends the one before it: classes near nothing else end at once, two that are near each other by pairs, and null scores by the rule."""
    seen = []
    whole = elimination._edges
    monkeypatch.setattr(elimination, "_edges", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = [(0, p, [float(i == p * 7 % 13) for i in range(13)], float(p // 3), "x") for p in range(6000)]
    got = elimination.survivors(spark.createDataFrame(rows, SCHEMA), 0.85)
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(rows, 0.85)
    assert sum(e.count() for e in seen) < 13 * 13
    two = [(0, p, [1.0, 0.1 * (p % 2), 0.0] if p % 3 else [0.0, 0.0, 1.0], float(p * 7 % 101), "x") for p in range(600)]
    got = elimination.survivors(spark.createDataFrame(two, SCHEMA), 0.85)
    assert {(r.query_id, r.pos) for r in got.collect()} == kept_by_fold(two, 0.85)
