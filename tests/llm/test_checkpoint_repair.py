"""Repairs against a search over all edit lists, long conversations over many blocks, odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from firstpast.llm import checkpoint_repair as cr
from firstpast.llm.queries import QUERIES

FOLLOWERS = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute_damage(rows):
    for conv, turn, role, text in rows:
        conv_said, turn_said, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_said}:{turn_said}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, turns) by Dijkstra over (rows used, last role's initial), least audit among equal costs.

    The result's roles are checked against the pattern afterwards."""
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, k, last, said = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done[k, last] = True
        if k == len(rows) and last in ("", "a"):
            assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said))
            return cost, audit, said

        def go(more, edit, used, role=None, text=None, cost=cost, audit=audit, k=k, said=said, last=last):
            if role is None:
                heapq.heappush(heap, (cost + more, audit + edit, k + used, last, said))
            elif role[:1] and role[:1] in FOLLOWERS[last]:
                heapq.heappush(heap, (cost + more, audit + edit, k + used, role[:1], (*said, (role, text))))

        for role in ("user", "assistant"):
            go(2, "I", 0, role, "")
        if k < len(rows):
            fault, role, text = rows[k]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                go(fault == "truncated", "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(2 + (fault == "truncated"), "R", 1, new, text)


def brute_one(rows):
    """The result columns behind the id, from the rows of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                      "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = cheapest([(f, r, t) for f, (_, r, t) in zip(faults, rows)])
    text = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def brute(rows):
    held = {}
    for conv, *rest in rows:
        held.setdefault(conv, []).append((conv, *rest))
    return sorted(((conv, *brute_one(list(brute_damage(some)))) for conv, some in held.items()), key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def table_of(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def random_rows(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        conv = None if c == 3 else c
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "student"])
            text = rng.choice(["yes.", "no", " \n", "", None, "Right!", f"turn {turn}.", f"open {turn}", "what? \t", "1!\x85"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 0, -turn]), role, text))
    return rows


def test_conversations(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select(
            "conv_id", "turn", "role", "text").collect()]
        assert reported(QUERIES["op13_checkpoint_repair"](spark, f"/root/testdata/{sf}")) == brute(rows)


@pytest.mark.parametrize("block, chars", [(4096, 1 << 20), (3, 1 << 20), (1, 1 << 20), (50, 12)])
def test_random_conversations_in_blocks_of_any_size(spark, block, chars):
    rows = random_rows(random.Random(block), 60, 14)
    rows += rows[::5]
    assert reported(cr.report(table_of(spark, rows), block, chars)) == brute(rows)


def test_one_conversation_with_most_rows_lies_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Said at {t}.", f"open {t}", "again."])) for t in range(700)]
    rows += random_rows(rng, 30, 6) + [(7, 50, "user", "many times the same.")] * 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = cr._ordered(cr.damaged(table_of(spark, rows)))
        parts = cr._blocks(ordered, 40, 1 << 20).where("conv_id = 7").select("part").distinct().count()
        assert parts > 1
        assert reported(cr.report(table_of(spark, rows), 40)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_inputs(spark):
    assert reported(cr.report(table_of(spark, []))) == []
    dropped = [(c, t, "user", "Hi.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [*dropped, (None, None, None, None), (500, None, "user", "x" * 3_000_000 + "."), (500, 1, "assistant", "ok."), (501, 0, "user", "")]
    assert dropped
    extra = table_of(spark, rows).selectExpr("*", "'x' AS copies", "1 AS part", "2 AS number", "'y' AS said", "0 AS content")
    got = reported(cr.report(extra))
    assert got == brute(rows)
    empty = hashlib.sha256(b"").hexdigest()
    gone = {c for c, *_ in dropped} - {c for c, t, *_ in rows if zlib.crc32(f"{c}:{t}".encode()) % 20}
    assert gone and all(r[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in got if r[0] in gone)


row = st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([-1, 0, 1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=12), st.integers(0, 12))
def test_blocks_of_a_walk_join_up(rows, cut):
    """A walk over two blocks is the walk over both, and matrices give the costs at their border."""
    left, right = rows[:cut], rows[cut:]
    border = cr.through(cr.transfer(right), cr.END)
    assert border == cr.checkpoints(right, cr.END)[1][0]
    assert cr.through(cr.transfer(left), border) == cr.checkpoints(rows, cr.END)[1][0]
    first, state = cr.walk(left, border, cr.START, False)
    second, _ = cr.walk(right, cr.END, state, True)
    assert first + second == cr.walk(rows, cr.END, cr.START, True)[0]
    names = {-1: "blank", 0: "", 1: "truncated"}
    cost, audit, _ = cheapest([(names[c], r, "") for r, c in rows])
    assert (cost, audit) == (cr.checkpoints(rows, cr.END)[1][0][cr.START], first + second)


def test_costs_are_stored_at_square_root_many_rows():
    rows = [("u", 0), ("a", 1)] * 5000
    step, kept = cr.checkpoints(rows, cr.END)
    assert step == 100 and len(kept) == 101
