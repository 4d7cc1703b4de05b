"""Operators 11 to 13 against brute force: resampling, conversation repair, sharding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise, product

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations, resampling, sharding
from tests.llm.fixtures import SCHEMA, awkward

PLAIN_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = PLAIN_WORD.findall(low)
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def expected_importance(rows, target, n, buckets, percent, least):
    own, aim = Counter(), Counter()
    for text in (r[1] for r in rows):
        own.update(zlib.crc32(f) % buckets for f in runs(text, n)[1])
    for text in target:
        aim.update(zlib.crc32(f) % buckets for f in runs(text, n)[1])
    s_all, t_all, out = sum(own.values()), sum(aim.values()), []
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    for doc_id, text, *_ in rows:
        words, found = runs(text, n)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-o[4], o[0] is not None, o[0] or 0) for o in out if o[1] >= least)
    return Counter(out), able[: len(able) * percent // 100]


@pytest.mark.parametrize(("n", "size"), [(1, 2**16), (1, 50), (3, 40), (2, 7)])
def test_importance(spark, n, size):
    docs = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    target = ["the lake by night was long", None, "", "Stars by THE hill w7 w8"]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    rows = resampling.importance(docs, aims, n=n, buckets=64, percent=50, size=size).collect()
    want, drawn = expected_importance(awkward(), target, n, 64, 50, 20)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows) == want
    got = sorted((r["rank"], -r.score, r.doc_id is not None, r.doc_id or 0) for r in rows if r["rank"])
    assert [g[1:] for g in got] == drawn and [g[0] for g in got] == list(range(1, len(drawn) + 1))


def test_chunks_own_their_starts():
    text = ("Über den Fluß, hin—her x " * 30 + "a" * 500 + " end").encode()
    for size, n in product((1, 5, 64, 1000), (1, 2, 4)):
        made = [f for piece, carry in resampling.overlapping(text, size, n) for f in resampling.features(piece, carry, n)[1]]
        assert Counter(made) == Counter(resampling.features(text, b"", n)[1])
        assert b"".join(p for p, _ in resampling.overlapping(text, size, n)) == text


def test_resample_gives_documents_back(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).withColumn("score", F.lit("mine")).withColumn("rank", F.lit(7))
    aims = spark.createDataFrame([("stars by the hill",)], "text string")
    rows = resampling.resample(docs, aims, percent=40).collect()
    assert docs.columns == list(rows[0].asDict()) and len(rows) == len([r for r in awkward() if len((r[1] or "").split()) >= 20]) * 40 // 100
    assert {r["score"] for r in rows} == {"mine"}
    assert resampling.resample(docs.limit(0), aims).count() == 0
    assert resampling.importance(docs, aims.limit(0)).count() == len(awkward())


# conversation repair


def cheapest(codes):
    """By trying all ways: each turn K, R or D, with insertions; the final initials must match (s?(ua)+)?"""
    best = None

    def go(i, state, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes) and state in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if cost > 40 or audit.endswith("IIII"):
            return
        for role in "ua":
            if (state, role) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                go(i, role, cost + 3, audit + "I")
        if i < len(codes):
            role, fault = codes[i]
            go(i + 1, state, cost + 4, audit + "D")
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if (state, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    go(i + 1, role, cost + more, audit + "K")
                for other in "ua":
                    if (state, other) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        go(i + 1, other, cost + 3 + more, audit + "R")

    go(0, "", 0, "")
    return best


def as_signature(codes):
    return "".join(conversations.letter(r, conversations.FAULTS.index(f)) for r, f in codes)


def finished(solved):
    options = [(solved[0, o][0] + 3 * len(conversations.CLOSE[o]), solved[0, o][1] + conversations.CLOSE[o]) for o in range(4) if (0, o) in solved]
    return min(options)


def test_solutions_equal_all_ways():
    chance = random.Random(12)
    for _ in range(300):
        codes = [(chance.choice("ssuuaa?"), chance.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(chance.randint(1, 5))]
        assert finished(conversations.solve(as_signature(codes))) == cheapest(codes), codes


def test_blocks_compose():
    chance = random.Random(3)
    for _ in range(60):
        parts = ["".join(chance.choice("aaabbbccdefgij") for _ in range(chance.randint(1, 6))) for _ in range(chance.randint(2, 5))]
        whole, relations = conversations.solve("".join(parts)), [conversations.relation(conversations.solve(p)) for p in parts]
        for (start, end), (cost, audit) in whole.items():
            states = conversations.path(relations, start, end)
            pieces = [conversations.solve(p)[a, b] for p, (a, b) in zip(parts, pairwise(states), strict=True)]
            assert (sum(c for c, _ in pieces), "".join(a for _, a in pieces)) == (cost, audit)


def brute_repair(rows):
    by_conv, out = defaultdict(list), {}
    for r in rows:
        by_conv[r[0]].append(r)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        seen, codes = set(), []
        for _, _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text or "")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append(((role or "?")[0] if (role or "?")[0] in "sua" else "?", fault))
        numbers = {r[1] for r in turns if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairwise(codes))
        cost, audit = finished(conversations.solve(as_signature(codes))) if len(codes) > 6 else cheapest(codes)
        i, last, lines = 0, "", []
        for edit in audit:
            other = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{other}:")
                last = other[0]
                continue
            if edit == "K":
                lines.append(f"{turns[i][2]}:{turns[i][3]}")
                last = turns[i][2][0]
            elif edit == "R":
                lines.append(f"{other}:{turns[i][3]}")
                last = other[0]
            i += 1
        out[conv] = (gaps, *[sum(f == k for _, f in codes) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_conversations():
    chance = random.Random(5)
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes!"),
        (2, None, "user", "null turn."), (2, None, None, "no role."), (2, 5, "user", None), (2, 5, "user", "tied."), (2, 5, "user", "tied."),
        (None, 1, "user", "of no one."), (None, 2, "assistant", "cut off"),
        (3, 0, "", ""), (3, 9, " ", " \t\n"),
        (4, 0, "tool", "x. \n"), (4, 1, "User", "capital."), (4, 2, "usher", "u too?"),
    ]
    for conv in range(5, 25):
        for turn in range(chance.randint(1, 6)):
            rows.append((conv, turn + chance.randint(0, 1), chance.choice(["user", "assistant", "system"]), chance.choice(["Same.", f"text {turn}.", f"cut {turn}", ""])))
    rows += [(99, t, chance.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"line {chance.randint(0, 400)}{chance.choice(['.', '!', ''])}") for t in range(700)]
    return rows


@pytest.mark.parametrize(("block", "fan"), [(256, 256), (5, 3)])
def test_repair_equals_brute_force(spark, block, fan):
    rows = made_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("mine")).repartition(3)
    done = conversations.repair(df, block, fan)
    digest = {r["_id"]: r.repaired_sha256 for r in conversations.digests(done.turns).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r["_id"], hashlib.sha256().hexdigest())) for r in done.audits.collect()}
    assert got == brute_repair(rows)


def test_query_of_repair_has_every_conversation(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {t}.") for c in range(150) for t in range(1 + c % 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversations.repaired_digests(df, conversations.repair(conversations.damaged(df))).collect()
    assert sorted(r.conv_id for r in out) == list(range(150))
    gone = [r for r in out if all(zlib.crc32(f"{r.conv_id}:{t}".encode()) % 20 == 0 for t in range(1 + r.conv_id % 3))]
    assert gone and all((r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256().hexdigest()) for r in gone)
    empty = df.limit(0)
    assert conversations.repaired_digests(empty, conversations.repair(empty)).count() == 0


# sharding


def test_flow_is_least(spark):
    chance = random.Random(7)
    for _ in range(40):
        supply = [chance.randint(0, 30) for _ in range(chance.randint(1, 6))]
        capacity = sharding.equal_capacities(sum(supply), chance.randint(1, 7))
        flow = sharding.least_cost_flow(supply, capacity)
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(len(supply))] == supply
        assert all(sum(a for (_, j), a in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        moved = sum(a for (i, j), a in flow.items() if i != j)
        assert moved == sum(supply) - sum(map(min, supply, capacity))


def test_flow_with_costs_equals_all_ways():
    chance = random.Random(8)
    for _ in range(60):
        supply, capacity = [chance.randint(0, 3) for _ in range(3)], [chance.randint(1, 4) for _ in range(3)]
        if sum(supply) > sum(capacity):
            continue
        price = [[chance.randint(0, 5) for _ in range(3)] for _ in range(3)]
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        least = min((sum(price[i][j] for i, j in zip(units, to, strict=True)) for to in product(range(3), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(3))), default=0)
        flow = sharding.least_cost_flow(supply, capacity, lambda i, j: price[i][j])
        assert sum(price[i][j] * a for (i, j), a in flow.items()) == least


def check_shards(rows, texts, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_reshard_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA).withColumn("size", F.lit("mine")).withColumn("shard", F.lit("mine"))
    rows = sharding.reshard(docs, sharding.hashed_shard(3), 4).collect()
    check_shards(rows, [(r[0], r[1]) for r in awkward()], 4)
    assert sharding.reshard(docs.limit(0), F.lit(0), 4).count() == 0
    assert {r.shard for r in sharding.reshard(docs, F.lit(None), 1).collect()} == {0}


def test_sizes_are_near_equal_and_moves_few(spark):
    texts = [(i, "x" * (i * 37 % 400)) for i in range(900)] + [(7, "same")] * 400
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.reshard(docs, F.when(F.col("doc_id") == 7, 0).otherwise(F.col("doc_id") % 5), 8).collect()
    check_shards(rows, texts, 8)
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8
    old = [sum(r.size for r in rows if r.old_shard == k) for k in range(5)] + [0] * 3
    least = sum(sizes) - sum(map(min, old, sharding.equal_capacities(sum(sizes), 8)))
    assert sum(r.size for r in rows if r.shard != r.old_shard) <= least + 8 * 400


def test_rewrite_touches_affected_files_only(spark, tmp_path):
    path = f"{tmp_path}/shards"
    rows = [(i, "a" * 9, 0) for i in range(100)] + [(i, "b" * 9, 1) for i in range(100, 180)] + [(i, "c" * 9, 2) for i in range(180, 300)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    stamp = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "shards" / "shard=0").glob("*.parquet")}
    before = stamp()
    assert sharding.rewrite(spark, path, 3) == [1, 2] and stamp() == before
    after = spark.read.parquet(path)
    assert sorted(r.doc_id for r in after.collect()) == list(range(300))
    assert [r["count"] for r in after.groupBy("shard").count().orderBy("shard").collect()] == [100, 100, 100]
    assert sharding.rewrite(spark, path, 3) == []
    assert sharding.rewrite(spark, path, 2) == [0, 1, 2]
    assert sorted((r["shard"], r["count"]) for r in spark.read.parquet(path).groupBy("shard").count().collect()) == [(0, 150), (1, 150)]
