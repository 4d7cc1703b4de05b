"""Operator 12: conversation structure repair by signature de-duplication.

A conversation's turns become a string, one letter for each turn's role and
fault: its signature. Conversations differ in their texts, but few signatures
differ, so each distinct one is solved once, by a memoised recursion over (turn,
last role), and the audits, one letter for each edit, are joined back and
replayed over the turns.

A conversation of any length is a line of blocks, each with a signature of at
most BLOCK letters. A block's solution says for each last role before it and
each after it what the cheapest edits cost, and how their audits compare; such
solutions compose (FAN at a time, level by level), so no task holds a long
conversation. Order inside a conversation comes from distributed prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KEY, Table, keyed, prefix_sums

#: The costs of edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What is blank, and what ends a turn that is whole.
SEEN, WHOLE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Parameters: turns of a block's signature; solutions that one task composes.
BLOCK, FAN = 256, 256

ROLES = "sua?"
FAULTS = ("", "truncated", "blank", "duplicate")
#: States of a repaired conversation: nothing yet, after the system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a turn of role s, u or a leads from each state.
FOLLOW = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that a new or renamed turn has after each state.
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Insertions that end a conversation well: none when it is empty or an assistant's turn is the last.
CLOSE = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAMES = {"u": "user", "a": "assistant"}


def letter(role: str, fault: int) -> str:
    """A turn's letter: a to d for s, u, a and other roles without a fault, the next four truncated, then blank and duplicate."""
    return chr(97 + 4 * fault + (ROLES.index(role) if role in "sua" and role else 3))


def meaning(sign: str) -> tuple[str, int]:
    """(role's initial or ?, fault) of a letter."""
    fault, role = divmod(ord(sign) - 97, 4)
    return ROLES[role], fault


def turn_edits(sign: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after) of what can become of a turn after ``state``."""
    role, fault = meaning(sign)
    yield "D", DELETE, state
    if fault < 2:
        more = TRUNCATED if fault else 0
        if (state, role) in FOLLOW:
            yield "K", KEEP + more, FOLLOW[state, role]
        yield "R", REROLE + more, FOLLOW[state, NEXT[state]]


def solve(signature: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) of a block to (least cost, the ASCII-least audit of that cost).

    Insertions stand before a turn; audits of one block all end with their last
    turn's edit, so none is the beginning of another, and the least one stays
    least whatever follows.
    """
    return {(start, goal): found for goal in STATES for start, found in _solve_to(signature, goal).items()}


def _solve_to(signature: str, goal: int) -> dict[int, tuple[int, str]]:
    """A memoised recursion over turns, asked for the last turns first, so that its depth doesn't grow with the signature."""

    @cache
    def best(i: int) -> dict[int, tuple[int, int, str, int]]:
        """State before turn i to (cost, rank among the states' audits from there, edits of turn i, state after them)."""
        if i == len(signature):
            return {goal: (0, 0, "", goal)}
        rest, found = best(i + 1), {}
        for state in STATES:
            options, here = [], state
            for inserted in ("", "I", "II", "III"):  # a fourth would repeat a state
                for edit, cost, after in turn_edits(signature[i], here):
                    if after in rest:
                        options.append((INSERT * len(inserted) + cost + rest[after][0], inserted + edit, rest[after][1], after))
                here = FOLLOW[here, NEXT[here]]
            if options:
                found[state] = min(options)
        order = sorted({o[1:3] for o in found.values()})
        return {s: (cost, order.index((edits, rank)), edits, after) for s, (cost, edits, rank, after) in found.items()}

    for i in range(len(signature), -1, -1):
        best(i)
    out = {}
    for start, (cost, *_) in best(0).items():
        audit, state = [], start
        for i in range(len(signature)):
            _, _, edits, state = best(i)[state]
            audit.append(edits)
        out[start] = cost, "".join(audit)
    return out


def relation(solved: dict[tuple[int, int], tuple[int, str]]) -> tuple[list[int], list[int]]:
    """16 costs (-1: impossible) and, for each state before, the order of the audits."""
    costs = [solved[s, o][0] if (s, o) in solved else -1 for s in STATES for o in STATES]
    ranks = []
    for s in STATES:
        order = sorted({solved[s, o][1] for o in STATES if (s, o) in solved})
        ranks += [order.index(solved[s, o][1]) if (s, o) in solved else -1 for o in STATES]
    return costs, ranks


def compose(left: tuple, right: tuple) -> tuple[list[int], list[int], list[int]]:
    """Costs, ranks and the states between of two relations, one after the other."""
    costs, ranks, between = [], [], []
    for s in STATES:
        keys = []
        for o in STATES:
            options = [(left[0][4 * s + m] + right[0][4 * m + o], left[1][4 * s + m], right[1][4 * m + o], m) for m in STATES if left[0][4 * s + m] >= 0 and right[0][4 * m + o] >= 0]
            keys.append(min(options, default=None))
        order = sorted({k[1:3] for k in keys if k})
        costs += [k[0] if k else -1 for k in keys]
        ranks += [order.index(k[1:3]) if k else -1 for k in keys]
        between += [k[3] if k else -1 for k in keys]
    return costs, ranks, between


def path(relations: list[tuple], start: int, end: int) -> list[int]:
    """The states before, between and after ``relations`` on the cheapest way from ``start`` to ``end``."""
    made, states = [relations[0]], [end]
    for r in relations[1:]:
        made.append(compose(made[-1], r))
    for whole in made[:0:-1]:
        states.append(whole[2][4 * start + states[-1]])
    return [start, *reversed(states)]


def replayed(signature: str, audit: str, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(turn or None, new role or None) of each turn of the repaired block."""
    turn = 0
    for edit in audit:
        if edit == "I":
            yield None, NAMES[NEXT[state]]
            state = FOLLOW[state, NEXT[state]]
            continue
        if edit == "K":
            state = FOLLOW[state, meaning(signature[turn])[0]]
            yield turn, None
        elif edit == "R":
            yield turn, NAMES[NEXT[state]]
            state = FOLLOW[state, NEXT[state]]
        turn += 1


def lettered(rows: DataFrame) -> DataFrame:
    """(_file, _row, _id, conv_id, turn, _sign, _at) of keyed rows: each turn's letter, and its place in its conversation."""
    said = F.sha2(F.concat_ws(":", F.coalesce(F.length("role"), F.lit(-1)), "role", "text"), 256)
    blank = F.col("text").isNull() | ~F.col("text").rlike(SEEN)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select(*KEY, F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_id"), "conv_id", "turn", "role", role.alias("_role"), blank.alias("_blank"), F.coalesce(F.col("text").rlike(WHOLE), F.lit(False)).alias("_whole"), said.alias("_said"), F.lit(1).cast("long").alias("_one"))
    placed = Table(prefix_sums(light, ["_id"], ["turn", "role", "_said", *KEY], "_one", out="_at"), "turns")
    again = placed.read().where("not _blank").groupBy("_id", "_said").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    seen = placed.read().join(again, ["_id", "_said"], "left")
    fault = F.when(F.col("_blank"), 2).when(F.col("_at") > F.col("_first"), 3).when(~F.col("_whole"), 1).otherwise(0)
    return seen.select(*KEY, "_id", "conv_id", "turn", F.char(97 + 4 * fault + F.col("_role")).alias("_sign"), "_at")


RELATION = "costs array<long>, ranks array<int>"


def solutions(signatures: DataFrame) -> DataFrame:
    """(signature, costs, ranks, audits, illegal) of each distinct signature, solved once."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for signature in batch.column(0).to_pylist():
                solved, roles = solve(signature), [meaning(x)[0] for x in signature]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(roles))
                out.append((*relation(solved), [solved.get((s, o), (0, None))[1] for s in STATES for o in STATES], illegal))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64()]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["signature", "costs", "ranks", "audits", "illegal"])

    return signatures.select("signature").distinct().mapInArrow(each, f"signature string, {RELATION}, audits array<string>, illegal long")


def _composed(level: DataFrame, fan: int) -> DataFrame:
    """The next level: (_id, at, costs, ranks), ``fan`` neighbours in one."""

    def whole(rows):
        import pandas as pd

        rows = rows.sort_values("at")
        costs, ranks = reduce(lambda a, b: compose(a, b)[:2], zip(rows["costs"], rows["ranks"], strict=True))
        return pd.DataFrame({"_id": [rows["_id"].iloc[0]], "at": [rows["at"].iloc[0] // fan], "costs": [list(costs)], "ranks": [list(ranks)]})

    return level.groupBy("_id", F.expr(f"at div {fan}").alias("up")).applyInPandas(whole, f"_id string, at long, {RELATION}")


def _descended(level: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """(_id, at, start, end) of a level's rows: the states before and after each, from those of the level above."""

    def parted(rows):
        rows = rows.sort_values("at")
        states = path(list(zip(rows["costs"], rows["ranks"], strict=True)), rows["start"].iloc[0], rows["end"].iloc[0])
        return rows[["_id", "at"]].assign(start=states[:-1], end=states[1:])

    placed = level.withColumn("up", F.expr(f"at div {fan}")).join(above.withColumnRenamed("at", "up"), ["_id", "up"])
    return placed.groupBy("_id", "up").applyInPandas(parted, "_id string, at long, start int, end int")


class Repair:
    """What :func:`repair` gives: ``audits``, a row for each conversation, and ``turns``, the repaired rows."""

    def __init__(self, audits: DataFrame, turns: DataFrame):
        self.audits, self.turns = audits, turns


def repair(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> Repair:
    """Repairs all ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    Turns go by ``turn``, nulls first; ties by role, then by a digest of role and
    text, so that equal rows are neighbours. A null text is blank, a null role
    is none of system, user, assistant; null conv_ids are one conversation. A
    turn that repeats an earlier one's role and text is a duplicate, also across
    tied turns. An empty table gives no rows.

    ``audits``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: conv_id, block, place (their order), role, text, and the stored
    row's key, null for inserted turns.
    """
    rows = keyed(conversations.select("conv_id", "turn", "role", "text"))
    letters = Table(lettered(rows), "letters")
    signs = letters.read().groupBy("_id", F.expr(f"_at div {block}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("_at", "_sign"))).alias("_signs"))  # a block's letters at most
    blocks = Table(signs.select("_id", "at", F.array_join(F.transform("_signs", lambda x: x["_sign"]), "").alias("signature")), "blocks")
    solved = Table(solutions(blocks.read()), "solved")
    level = Table(blocks.read().join(solved.read().select("signature", "costs", "ranks"), "signature").select("_id", "at", "costs", "ranks"), "level")
    long_ = Table(blocks.read().where("at > 0").select("_id").distinct(), "long")  # conversations of one block, nearly all, have nothing to compose
    levels = [Table(level.read().join(long_.read(), "_id", "left_semi"), "level")]
    for _ in range(_levels(blocks.read().agg(F.max("at")).first()[0] or 0, fan)):
        levels.append(Table(_composed(levels[-1].read(), fan), "level"))
    roots = level.read().join(long_.read(), "_id", "left_anti").unionByName(levels[-1].read())
    ends = F.array(*[F.struct(F.expr(f"costs[{o}]").alias("cost"), F.expr(f"ranks[{o}]").alias("rank"), F.lit(o).alias("end"), F.lit(INSERT * len(CLOSE[o])).alias("more")) for o in STATES])
    ends = F.transform(F.filter(ends, lambda x: x["cost"] >= 0), lambda x: F.struct((x["cost"] + x["more"]).alias("cost"), x["rank"], x["end"].alias("end")))
    top = Table(roots.select("_id", F.array_min(ends).alias("e")).select("_id", F.col("e.cost").alias("cost"), F.col("e.end").alias("last")), "top")
    whole = top.read().select("_id", F.lit(0).cast("long").alias("at"), F.lit(EMPTY).alias("start"), F.col("last").alias("end"))
    down = whole.join(long_.read(), "_id", "left_semi")
    for lower in levels[-2::-1]:
        down = Table(_descended(lower.read(), down, fan), "down").read()
    down = whole.join(long_.read(), "_id", "left_anti").unionByName(down)
    return _assembled(rows, letters, blocks, solved, top, down, block)


def _levels(most: int, fan: int) -> int:
    out = 0
    while most:
        most, out = most // fan, out + 1
    return out


def _assembled(rows: DataFrame, letters: Table, blocks: Table, solved: Table, top: Table, down: DataFrame, block: int) -> Repair:
    """Joins the audits back to conversations, and replays them over the turns."""
    sums = letters.read().groupBy("_id").agg(
        F.first("conv_id").alias("conv_id"),
        F.count("*").alias("turns"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if((F.ascii("_sign") - 97).between(4 * f, 4 * f + 3)).alias(name) for f, name in enumerate(FAULTS) if f],
    )
    parts = blocks.read().join(solved.read().select("signature", "audits", "illegal"), "signature").join(down, ["_id", "at"]).join(top.read(), "_id").join(sums.select("_id", "turns"), "_id")
    close = F.when(F.col("at") == F.expr(f"(turns - 1) div {block}"), F.element_at(F.array(*[F.lit(CLOSE[s]) for s in STATES]), F.col("end") + 1)).otherwise("")
    parts = Table(parts.select("_id", "at", "signature", "start", "illegal", F.concat(F.expr("audits[4 * start + end]"), close).alias("audit")), "parts")
    sides = parts.read().select("_id", F.explode(F.array(F.struct(F.col("at").alias("edge"), F.substring("signature", -1, 1).alias("x"), F.lit(None).cast("string").alias("y")), F.struct((F.col("at") - 1).alias("edge"), F.lit(None).cast("string").alias("x"), F.substring("signature", 1, 1).alias("y")))).alias("s"))
    role = lambda c: F.substring(F.lit(ROLES), (F.ascii(c) - 97) % 4 + 1, F.lit(1))
    edges = sides.groupBy("_id", "s.edge").agg(F.max("s.x").alias("x"), F.max("s.y").alias("y")).where("x is not null and y is not null")
    edges = edges.groupBy("_id").agg(F.count_if(~F.concat(role("x"), role("y")).isin("su", "ua", "au")).alias("between"))
    audits = parts.read().groupBy("_id").agg(F.sum("illegal").alias("inside"), F.array_sort(F.collect_list(F.struct("at", "audit"))).alias("a"))
    audits = audits.join(edges, "_id", "left").join(top.read(), "_id").join(sums, "_id")
    audits = audits.select("_id", "conv_id", "gaps", *FAULTS[2:], FAULTS[1], (F.col("inside") + F.coalesce("between", F.lit(0))).alias("illegal"), "cost", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))

    def replay(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                conv, at, signature, start, audit = (batch.column(c)[i].as_py() for c in ("_id", "at", "signature", "start", "audit"))
                made = list(replayed(signature, audit, start))
                turn = [None if t is None else t + at * block for t, _ in made]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(made), pa.string()), pa.array([at] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32()), pa.array(turn, pa.int64()), pa.array([r for _, r in made], pa.string())], names=["_id", "block", "place", "_at", "_new"])

    edits = parts.read().select("_id", "at", "signature", "start", "audit").mapInArrow(replay, "_id string, block long, place int, _at long, _new string")
    named = edits.join(letters.read().select("_id", "_at", *[F.col(k).alias(f"_p{k}") for k in KEY]), ["_id", "_at"], "left").join(sums.select("_id", "conv_id"), "_id")
    texts = rows.select(*[F.col(k).alias(f"_q{k}") for k in KEY], "role", "text")
    turns = named.join(texts, (F.col(f"_p{KEY[0]}") == F.col(f"_q{KEY[0]}")) & (F.col(f"_p{KEY[1]}") == F.col(f"_q{KEY[1]}")), "left")
    turns = turns.select("_id", "conv_id", "block", "place", F.coalesce("_new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"_p{k}").alias(k) for k in KEY])
    return Repair(audits, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(_id, repaired_sha256): the SHA-256 of each conversation's ``role:text`` lines, which run through one hasher as they come; no text is gathered."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(conv: str, digest):
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["_id", "repaired_sha256"])

        current, digest = None, None
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if conv != current:
                    if digest:
                        yield row(current, digest)
                    current, digest = conv, hashlib.sha256()
                    digest.update(line.as_py().encode())
                else:
                    digest.update(b"\n" + line.as_py().encode())
        if digest:
            yield row(current, digest)

    lines = turns.select("_id", "block", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("_id").sortWithinPartitions("_id", "block", "place")
    return lines.select("_id", "line").mapInArrow(run, "_id string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32(conv_id:turn) % 20; nulls of role and text are one space first."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_c")).where("_c <> 0")
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repaired_digests(conversations: DataFrame, repaired: Repair) -> DataFrame:
    """The contract's columns, for every conv_id of ``conversations``; those without turns have zeros, an empty audit and the empty text's digest."""
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = conversations.select("conv_id").distinct().withColumn("_id", name)
    both = every.join(repaired.audits.drop("conv_id"), "_id", "left").join(digests(repaired.turns), "_id", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
