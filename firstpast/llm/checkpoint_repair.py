"""Repair of conversations: the cheapest edits that make their roles alternate, found by a checkpointed DP.

The DP runs over the rows of a conversation and over what was said last: nothing yet, system, user, assistant. Its
backward costs (the cheapest way to end well from a row on) are four numbers a row. They are stored only at
checkpoints, every square root of the rows; walking forward from the first row, a block's costs are worked out again
from the checkpoint behind it, and at every row the ASCII-least edit that keeps the cost is taken. Equal costs
cannot lead to one edit list that begins another, so the choice row by row gives the least list.

Rows are ordered by range partitions over (conversation, turn, role, text), so a conversation may lie in several of
them. A task reads its range as a stream in blocks of ``BLOCK`` rows. A conversation that lies inside a block is
repaired there. Of others every block is written with its transfer: a block takes the four costs behind it to the
four before it, as a matrix of sums and minima. Small rows of matrices give the costs at all blocks' borders,
from the last to the first; with these every block is walked by itself from each of the four states; then one stream per
conversation picks the states and writes the result.

Defined cases: NULL roles and texts are one space, NULL turns come first, a NULL id is one conversation; rows of
one turn are ordered by role and text; a conversation that damage leaves without rows has zeros and an empty audit; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain, count, groupby
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import SLICE, arrow_schema, slices
from firstpast.session import materialize

# Rows and characters of a block.
BLOCK = 4096
BLOCK_CHARS = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
FAR = 1 << 60

# States: nothing yet, after system, after user, after assistant. What may follow, by initial.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# The only user or assistant turn that may follow.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
GOOD_END = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

Costs = tuple[int, int, int, int]
# A row for the DP: the initial of its role if it may stay ("" where it must go), and the cost of leaving it.
Row = tuple[str, int]


# -- the programme over states -------------------------------------------------------

def inserted(costs: Sequence[int]) -> Costs:
    """The costs where turns may be inserted first; two insertions lead to any state there is."""
    best = list(costs)
    for _ in range(2):
        best = [min(best[s], COST[INSERT] + best[NEXT[s]]) for s in STATES]
    return tuple(best)


END: Costs = inserted([0 if s in GOOD_END else FAR for s in STATES])


def before(row: Row, after: Sequence[int]) -> Costs:
    """The costs in front of a row from those behind it."""
    initial, kept = row
    best = []
    for s in STATES:
        cost = COST[DELETE] + after[s]
        if kept >= 0:
            cost = min(cost, COST[REROLE] + kept + after[NEXT[s]])
            if initial in FOLLOWS[s]:
                cost = min(cost, kept + after[FOLLOWS[s][initial]])
        best.append(cost)
    return inserted(best)


def transfer(rows: Sequence[Row]) -> list[Costs]:
    """Row k: the costs in front of the rows if ending in state k behind them costs nothing and no other state will do."""
    columns = []
    for k in STATES:
        costs: Costs = tuple(0 if s == k else FAR for s in STATES)
        for row in reversed(rows):
            costs = before(row, costs)
        columns.append(costs)
    return columns


def through(columns: Sequence[Sequence[int]], after: Sequence[int]) -> Costs:
    return tuple(min(columns[k][s] + after[k] for k in STATES) for s in STATES)


def checkpoints(rows: Sequence[Row], after: Costs) -> tuple[int, list[Costs]]:
    """The distance of checkpoints, and the costs behind every stretch of that many rows."""
    step = max(1, isqrt(len(rows)))
    kept, costs = [], after
    for start in reversed(range(0, len(rows), step)):
        kept.append(costs)
        for row in reversed(rows[start:start + step]):
            costs = before(row, costs)
    kept.append(costs)
    return step, kept[::-1]


def walk(rows: Sequence[Row], after: Costs, state: int, last: bool) -> tuple[str, int]:
    """The least edits of the rows from a state on, and the state behind them; ``last``: nothing follows."""
    edits: list[str] = []
    step, kept = checkpoints(rows, after)
    for block, start in enumerate(range(0, len(rows), step)):
        some = rows[start:start + step]
        # costs[i]: in front of row i of this stretch, worked out again from the checkpoint behind it.
        costs = [kept[block + 1]]
        for row in reversed(some):
            costs.append(before(row, costs[-1]))
        costs.reverse()
        for (initial, cost), here, behind in zip(some, costs, costs[1:]):
            while True:
                if COST[DELETE] + behind[state] == here[state]:
                    edits.append(DELETE)
                    break
                if COST[INSERT] + here[NEXT[state]] == here[state]:
                    edits.append(INSERT)
                    state = NEXT[state]
                    continue
                follows = FOLLOWS[state].get(initial) if cost >= 0 else None
                if follows is not None and cost + behind[follows] == here[state]:
                    edits.append(KEEP)
                    state = follows
                else:
                    edits.append(REROLE)
                    state = NEXT[state]
                break
    while last and state not in GOOD_END:
        edits.append(INSERT)
        state = NEXT[state]
    return "".join(edits), state


# -- rows of a conversation ------------------------------------------------------------

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What damage leaves of every row, ``copies`` telling how often; dropped rows have none."""
    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known(conv), known(turn)).cast("binary")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text")))
    return rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per distinct row with its copies; conversations without any have one without role and text."""
    there = F.col("copies") > 0
    return (rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "copies")
            .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows in ranges over the whole order; a large conversation has several ranges."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return (_distinct(rows).repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "text", "copies"))


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str

    @property
    def row(self) -> Row:
        gone = self.fault in ("blank", "duplicate")
        return self.role[:1], -1 if gone else int(self.fault == "truncated")


def own_fault(text: str) -> str:
    """The fault that a text has by itself."""
    said = text.rstrip(SPACES)
    if not said:
        return "blank"
    return "" if said[-1] in ".!?" else "truncated"


def judged(turns: Iterable[Turn]) -> list[Turn]:
    """The turns of a whole conversation, what was said earlier marked."""
    seen: set[tuple[str, str]] = set()
    out = []
    for t in turns:
        again = (t.role, t.text) in seen
        seen.add((t.role, t.text))
        out.append(t._replace(fault="duplicate") if again and t.fault != "blank" else t)
    return out


class Tally(NamedTuple):
    """Counts over neighbouring rows, and what is needed where two such runs meet."""
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    low: int | None
    high: int | None
    left: str | None
    right: str | None


NOTHING = Tally(0, 0, 0, 0, 0, None, None, None, None)


def tally(turns: Sequence[Turn]) -> Tally:
    faults = [t.fault for t in turns]
    starts = [t.role[:1] for t in turns]
    known = [t.turn for t in turns if t.turn is not None]
    return Tally(faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                 sum(a + b not in LEGAL for a, b in zip(starts, starts[1:])), len(set(known)),
                 known[0] if known else None, known[-1] if known else None,
                 starts[0] if starts else None, starts[-1] if starts else None)


def met(x: Tally, y: Tally) -> Tally:
    border = x.right is not None and y.left is not None and x.right + y.left not in LEGAL
    shared = x.high is not None and x.high == y.low
    return Tally(x.blank + y.blank, x.duplicate + y.duplicate, x.truncated + y.truncated, x.illegal + y.illegal + border,
                 x.turns + y.turns - shared, y.low if x.low is None else x.low, x.high if y.high is None else y.high,
                 y.left if x.left is None else x.left, x.right if y.right is None else y.right)


class Repaired:
    """Digest of the repaired turns, written one by one."""

    def __init__(self):
        self.digest, self.said = hashlib.sha256(), False

    def add(self, turns: Sequence[Turn], edits: str, state: int) -> None:
        left = iter(turns)
        for edit in edits:
            turn = next(left) if edit != INSERT else None
            if edit == DELETE:
                continue
            if edit == KEEP:
                role, state = turn.role, FOLLOWS[state][turn.role[:1]]
            else:
                state = NEXT[state]
                role = ROLE_OF[state]
            self.digest.update(f"{chr(10) * self.said}{role}:{turn.text if turn else ''}".encode())
            self.said = True


_TALLY = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, left string, right string"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(total: Tally, cost: int, audit: str, repaired: Repaired) -> tuple:
    gaps = 0 if total.low is None else total.high - total.low + 1 - total.turns
    return gaps, total.blank, total.duplicate, total.truncated, total.illegal, cost, audit, repaired.digest.hexdigest()


def repaired_at_once(turns: Sequence[Turn]) -> tuple:
    """The result of a conversation that is one block."""
    rows = [t.row for t in turns]
    audit, _ = walk(rows, END, START, True)
    done = Repaired()
    done.add(turns, audit, START)
    cost = checkpoints(rows, END)[1][0][START]
    return _result(tally(turns), cost, audit, done)


# -- the job -----------------------------------------------------------------------------

_TURNS = "array<struct<turn:long,role:string,text:string,fault:string>>"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _rows(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple]:
    for batch in slices(batches, size):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], fields: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some), fields)], schema=fields)


def _in_blocks(turns: Iterable[Turn], rows: int, chars: int) -> Iterator[list[Turn]]:
    block: list[Turn] = []
    size = 0
    for turn in turns:
        if block and (len(block) == rows or size + len(turn.text) > chars):
            yield block
            block, size = [], 0
        block.append(turn)
        size += len(turn.text)
    yield block


def _blocks(ordered: DataFrame, rows: int, chars: int) -> DataFrame:
    """Finished conversations, and the blocks of those that may go on in another block or range."""
    schema = f"conv_id {_kind(ordered)}, part long, number long, done struct<{_RESULT}>, said {_TURNS}"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbers = count()

        def made() -> Iterator[tuple]:
            conversations = groupby(_rows(batches, SLICE), key=lambda r: r[0])
            first, following = True, next(conversations, None)
            while following is not None:
                conv, some = following
                turns = (Turn(turn, role, text, own_fault(text))
                         for _, turn, role, text, copies in some for _ in range(copies))
                blocks = _in_blocks(turns, rows, chars)
                one, another = next(blocks), next(blocks, None)
                rest = [one] if another is None else chain([one, another], blocks)
                if another is not None:
                    for said in rest:
                        yield conv, part, next(numbers), None, [t._asdict() for t in said]
                following = next(conversations, None)
                if another is None and (first or following is None):
                    # The first and last conversation of a range may have rows in the ranges beside it.
                    yield conv, part, next(numbers), None, [t._asdict() for t in one]
                elif another is None:
                    yield conv, part, next(numbers), dict(zip(_NAMES, repaired_at_once(judged(one)))), None
                first = False

        # Results are small, blocks are not.
        for large, some in groupby(made(), key=lambda r: r[4] is not None):
            yield from _batches(some, fields, 1 if large else 256)

    return ordered.mapInArrow(task, schema)


def _again(blocks: DataFrame) -> DataFrame:
    """``again``: the places in a block whose role and text the conversation has said before."""
    each = blocks.select("conv_id", "part", "number", F.posexplode("said").alias("place", "one"))
    content = F.md5(F.concat_ws(":", F.length("one.role"), "one.role", "one.text"))
    at = F.struct("part", "number", "place")
    rows = each.select("conv_id", F.unhex(content).alias("content"), at.alias("at"))
    # One row per content: many rows that say the same are split by the skew join.
    firsts = rows.groupBy(F.col("conv_id").alias("conv"), F.col("content").alias("same")).agg(F.min("at").alias("earliest"))
    later = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("content") == F.col("same")))
    return (later.where("at > earliest").groupBy("at.part", "at.number").agg(F.collect_list("at.place").alias("again")))


def _transfers(blocks: DataFrame) -> DataFrame:
    """Of every block the initials and costs of its rows, its counts and its matrix; no texts."""
    schema = (f"conv_id {_kind(blocks)}, part long, number long, starts array<string>, costs array<int>, "
              f"matrix array<long>, tally struct<{_TALLY}>")
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, part, number, said, again in _rows(batches, 1):
                repeated = set(again or ())
                turns = [Turn(**t) for t in said]
                turns = [t._replace(fault="duplicate") if k in repeated and t.fault != "blank" else t
                         for k, t in enumerate(turns)]
                rows = [t.row for t in turns]
                matrix = [c for column in transfer(rows) for c in column]
                yield conv, part, number, [r[0] for r in rows], [r[1] for r in rows], matrix, tally(turns)._asdict()

        return _batches(made(), fields, 16)

    marked = blocks.join(_again(blocks), ["part", "number"], "left")
    return marked.select("conv_id", "part", "number", "said", "again").mapInArrow(task, schema)


def _borders(transfers: DataFrame) -> DataFrame:
    """``behind``: the costs behind every block, its conversation's matrices read from the last to the first."""
    schema = "part long, number long, behind array<long>, last boolean"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for _, some in groupby(_rows(batches, SLICE), key=lambda r: r[0]):
                costs, last = END, True
                for _, part, number, matrix in some:
                    yield part, number, list(costs), last
                    costs, last = through([matrix[k * 4:k * 4 + 4] for k in STATES], costs), False

        return _batches(made(), fields, 1024)

    small = transfers.select("conv_id", "part", "number", "matrix").repartition("conv_id")
    return small.sortWithinPartitions("conv_id", F.desc("part"), F.desc("number")).mapInArrow(task, schema)


def _walks(transfers: DataFrame) -> DataFrame:
    """Every block's edits and end state from each of the four states, and the costs in front of it."""
    schema = f"part long, number long, tally struct<{_TALLY}>, cost array<long>, edits array<string>, ends array<int>"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for part, number, starts, costs, counted, behind, last in _rows(batches, 16):
                rows, after = list(zip(starts, costs)), tuple(behind)
                walks = [walk(rows, after, s, last) for s in STATES]
                cost = checkpoints(rows, after)[1][0]
                yield part, number, counted, list(cost), [w[0] for w in walks], [w[1] for w in walks]

        return _batches(made(), fields, 16)

    both = transfers.join(_borders(transfers), ["part", "number"])
    return both.select("part", "number", "starts", "costs", "tally", "behind", "last").mapInArrow(task, schema)


def _stitched(blocks: DataFrame) -> DataFrame:
    """One result per conversation from its blocks in order."""
    schema = f"conv_id {_kind(blocks)}, {_RESULT}"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, some in groupby(_rows(batches, 1), key=lambda r: r[0]):
                total, audit, state, done, whole = NOTHING, [], START, Repaired(), None
                for _, said, counted, cost, edits, ends in some:
                    whole = cost[START] if whole is None else whole
                    total = met(total, Tally(**counted))
                    done.add([Turn(**t) for t in said], edits[state], state)
                    audit.append(edits[state])
                    state = ends[state]
                yield (conv, *_result(total, whole, "".join(audit), done))

        return _batches(made(), fields, 256)

    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.select("conv_id", "said", "tally", "cost", "edits", "ends").mapInArrow(task, schema)


def repaired(rows: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """The result for every conversation of ``conv_id, turn, role, text, copies``."""
    # Ranges and numbers name blocks, so they are written once and read from there.
    blocks = materialize(_blocks(_ordered(rows), block, chars), "repair-blocks")
    finished = blocks.where("done IS NOT NULL").select("conv_id", "done.*")
    going_on = blocks.where("done IS NULL").select("conv_id", "part", "number", "said")
    transfers = materialize(_transfers(going_on), "repair-transfers")
    walks = materialize(_walks(transfers), "repair-walks")
    return finished.unionByName(_stitched(going_on.join(walks, ["part", "number"])))


def report(rows: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Damage to ``conv_id, turn, role, text``, faults found and the cheapest repair, per conversation."""
    return repaired(damaged(rows), block, chars)
