"""Approximate nearest neighbours: random-projection trees searched through one queue, exact reranking.

A tree splits by hyperplanes between the means of two halves of the vectors at a node, found on a
sample of about ``SAMPLE`` vectors, never twice as many; every vector is then sent down all trees. Where
leaves of the sample's trees would hold more than ``LEAF_ROWS`` vectors of the table,
they are split on by random hyperplanes through the leaf's mean, as many levels as the table's
size asks for, so that a leaf's size does not grow with the table.

A query keeps one priority queue for all trees, ordered by the worst margin on the way to a node,
and opens leaves in that order. How many is measured, not guessed: the true neighbours of ``PROBES`` queries are found by
brute force over all vectors, and every query opens as many leaves as those needed to reach ``RECALL`` of them. Vectors without structure
need a large part of all leaves, vectors with clusters very few. Queries meet the vectors of a leaf in the
task that holds it, where cosines are computed in double precision; a leaf with many vectors or
queries is cut into cells. Of each cell a query takes its best, and the best of all cells are its result.

Copies of a vector beyond the first six by id cannot be among the five nearest of anything, as
a query leaves out only itself; they are dropped in the tasks that read them, by rank. Queries with
the same vector are searched once.

Defined cases: NULL vectors, those with NULL or non-finite components or only zeros, and those of another length
than most of the sample take no part; a NULL id takes no part; repeated rows count once for each
id; ties go to the smaller id; an empty table gives no rows; fewer candidates than asked for are all returned,
and a table with fewer vectors than ``SAMPLE_LEAF`` is one leaf. A query whose leaves hold fewer vectors than asked for
opens four times as many, and so on up to all of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.llm.common import hashed_sample, slices
from firstpast.session import materialize

NEAREST = 5
TREES = 12
SAMPLE = 20_000
SAMPLE_LEAF = 100
LEAF_ROWS = 400
CELL = 4096
# Queries that the effort is measured on, and the part of their neighbours that it has to find.
PROBES = 64
RECALL = 0.96


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


# -- trees -----------------------------------------------------------------------

@dataclass
class Tree:
    """Inner nodes with a direction, a border and two children; a child below zero is leaf ``-1 - child``."""

    direction: np.ndarray
    border: np.ndarray
    child: np.ndarray  # (node, side)
    mean: np.ndarray  # of each leaf
    further: np.ndarray  # directions of the levels below the leaves, shared by all of them

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row; levels below the sample's leaves are bits."""
        at = np.zeros(len(rows), np.int64) if len(self.border) else np.full(len(rows), -1)
        while len(inner := np.nonzero(at >= 0)[0]):
            node = at[inner]
            side = np.einsum("ij,ij->i", rows[inner], self.direction[node]) > self.border[node]
            at[inner] = self.child[node, side.astype(int)]
        leaf = -1 - at
        code = leaf.copy()
        for direction in self.further:
            code = code * 2 + (rows @ direction > self.mean[leaf] @ direction)
        return code


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def grow(rows: np.ndarray, rng: np.random.Generator, further: int) -> Tree:
    directions, borders, children, means = [], [], [], []

    def split(held: np.ndarray) -> int:
        own = rows[held]
        if len(held) > SAMPLE_LEAF:
            two = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(6):  # the means of the two halves, a few rounds
                side = own @ (two[1] - two[0]) > (two[1] - two[0]) @ (two[0] + two[1]) / 2
                if side.all() or not side.any():
                    break
                two = np.stack([own[~side].mean(0), own[side].mean(0)])
            direction = two[1] - two[0]
            if not np.linalg.norm(direction):
                direction = rng.standard_normal(rows.shape[1])
            direction = direction / np.linalg.norm(direction)
            along = own @ direction
            border = float(direction @ (two[0] + two[1]) / 2)
            # A lopsided split makes deep trees: the median then.
            if not 0.1 < (along > border).mean() < 0.9:
                border = float(np.median(along))
            side = along > border
            if side.any() and not side.all():
                node = len(borders)
                directions.append(direction)
                borders.append(border)
                children.append([0, 0])
                children[node] = [split(held[~side]), split(held[side])]
                return node
        means.append(own.mean(0) if len(own) else np.zeros(rows.shape[1]))
        return -len(means)

    split(np.arange(len(rows)))
    width = rows.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(borders), np.array(children, np.int64).reshape(-1, 2),
                np.array(means), unit(rng.standard_normal((further, width))) if further else np.zeros((0, width)))


def leaves_in_order(trees: list[Tree], query: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, the least bad margin first."""
    margins = [(t.direction @ query - t.border).tolist() for t in trees]
    queue = [(0.0, k, 0 if len(t.border) else -1, -1, 0) for k, t in enumerate(trees)]
    below: dict[tuple[int, int], list[float]] = {}
    while queue:
        bad, k, at, code, depth = heapq.heappop(queue)
        tree = trees[k]
        if at >= 0:
            margin = margins[k][at]
            near = int(margin > 0)
            for side in (0, 1):
                cost = bad if side == near else max(bad, abs(margin))
                heapq.heappush(queue, (cost, k, int(tree.child[at, side]), -1, 0))
            continue
        if code < 0:
            code = -1 - at
        if depth == len(tree.further):
            yield k, code
            continue
        leaf = -1 - at
        if (k, leaf) not in below:
            below[k, leaf] = (tree.further @ (query - tree.mean[leaf])).tolist()
        margin = below[k, leaf][depth]
        for side in (0, 1):
            cost = bad if side == (margin > 0) else max(bad, abs(margin))
            heapq.heappush(queue, (cost, k, at, code * 2 + side, depth + 1))


def fit(vectors: DataFrame, rows: int) -> list[Tree]:
    """Trees on about ``SAMPLE`` vectors chosen by hash; ``rows`` is how many vectors there are in all."""
    some = sorted(hashed_sample(vectors, SAMPLE, "id", of=rows).select("id", "vector").collect(), key=lambda r: r.id)
    widths = [len(r.vector) for r in some]
    if not widths:
        return []
    width = max(sorted(set(widths)), key=widths.count)
    sample = unit(np.array([r.vector for r in some if len(r.vector) == width], np.float64))
    rng = np.random.default_rng(11)
    leaves = max(1, len(sample) / SAMPLE_LEAF * 1.5)
    further = max(0, math.ceil(math.log2(rows / leaves / LEAF_ROWS)))
    return [grow(sample, rng, further) for _ in range(TREES)]


# -- search ------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(vectors: DataFrame, trees: list[Tree], leaves: int | None) -> DataFrame:
    """``id, vector, tree, leaf``: a row per tree, or per opened leaf if ``leaves`` are to be opened."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = unit(_matrix(batch.column(1)))
            if leaves is None:
                places = [np.column_stack([np.full(len(rows), k), t.leaf(rows)]) for k, t in enumerate(trees)]
                source, place = np.tile(np.arange(len(rows)), len(trees)), np.concatenate(places)
            else:
                ways = [list(islice(leaves_in_order(trees, row), leaves)) for row in rows]
                source = np.repeat(np.arange(len(rows)), [len(w) for w in ways])
                place = np.array([p for w in ways for p in w], np.int64).reshape(-1, 2)
            for at in range(0, len(source), 1 << 14):
                part = batch.take(pa.array(source[at:at + (1 << 14)]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(place[at:at + (1 << 14), 0]), pa.array(place[at:at + (1 << 14), 1])],
                    ["id", "vector", "tree", "leaf"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(task, f"id long, vector {kind}, tree long, leaf long")


def _cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal cosines."""
    return (one * many).sum(1) / (np.sqrt((one * one).sum(1)) * np.sqrt((many * many).sum(1)))


def _best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of each query's best rows of a cell, ties to smaller ids."""
    rough = unit(queries) @ unit(rows).T
    keep = min(best, len(rows))
    floor = np.partition(rough, len(rows) - keep, axis=1)[:, len(rows) - keep, None] - 1e-9
    q, r = np.nonzero(rough >= floor)
    exact = _cosines(queries[q], rows[r])
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < keep], r[place < keep], exact[place < keep]


def _true_neighbours(vectors: DataFrame, probes: DataFrame, best: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each probe's vector and those of its best others, by brute force: the probes against all rows, in blocks."""
    asked = probes.select("id", "vector").collect()
    ids, queries = np.array([r.id for r in asked], np.int64), np.array([r.vector for r in asked], np.float64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            rows, own = _matrix(batch.column(1)), batch.column(0).to_numpy()
            q, r, score = _best(queries, rows, own, best + 1)
            other = own[r] != ids[q]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q[other]]), pa.array(own[r[other]]), pa.array(score[other]), batch.column(1).take(pa.array(r[other]))],
                ["probe", "id", "score", "vector"])

    kind = vectors.schema["vector"].dataType.simpleString()
    found = vectors.select("id", "vector").mapInArrow(task, f"probe long, id long, score double, vector {kind}")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
    near: dict[int, list] = {}
    for r in found.withColumn("place", place).where(F.col("place") <= best).collect():
        near.setdefault(r.probe, []).append(r.vector)
    return [(q, np.array(near[i], np.float64)) for i, q in zip(ids.tolist(), queries) if i in near]


def effort(vectors: DataFrame, queries: DataFrame, trees: list[Tree], best: int) -> int:
    """Leaves that a query must open for ``RECALL`` of the neighbours to be in them, measured on ``PROBES`` queries."""
    spark = vectors.sparkSession
    known = _true_neighbours(vectors, hashed_sample(queries, PROBES, "id"), best)
    if not known:
        return 1
    rows = spark.createDataFrame(
        [(q.tolist(), [n.tolist() for n in near]) for q, near in known], "probe array<double>, near array<array<double>>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            query, near = (unit(np.atleast_2d(np.array(c.to_pylist()[0]))) for c in batch.columns)
            wanted: dict[tuple[int, int], list[int]] = {}
            for k, tree in enumerate(trees):
                for n, leaf in enumerate(tree.leaf(near).tolist()):
                    wanted.setdefault((k, leaf), []).append(n)
            needed: dict[int, int] = {}
            for count, place in enumerate(leaves_in_order(trees, query[0]), 1):
                for n in wanted.get(place, ()):
                    needed.setdefault(n, count)
                if len(needed) == len(near):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(list(needed.values()), pa.int64())], ["needed"])

    spread = rows.repartition(min(len(known), spark.sparkContext.defaultParallelism))
    needed = sorted(r.needed for r in spread.mapInArrow(task, "needed long").collect())
    return needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))]


def _search(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell (tree, leaf, a, b), vectors of the table before queries."""
    held: list[pa.RecordBatch] = []
    cell = None

    def answer() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        asked = whole.column(4).to_numpy(zero_copy_only=False)
        if asked.all() or not asked.any():
            return
        ids, rows = whole.column(5).to_numpy(), _matrix(whole.column(6))
        q, r, score = _best(rows[asked], rows[~asked], ids[~asked], best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[asked][q]), pa.array(ids[~asked][r]), pa.array(score)], ["rep", "vec_id", "score"])

    for batch in slices(batches, 4096):
        keys = np.column_stack([c.to_numpy() for c in batch.columns[:4]])
        bounds = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(keys[a])
            if key != cell and held:
                yield from answer()
                held = []
            cell = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from answer()


def _cells(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """Both sides in their cells: a leaf's vectors cut into ``a`` parts and its queries into ``b``."""
    parts = []
    for side, name in ((placed, "a"), (asked, "b")):
        parts.append(side.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL).alias(f"{name}_parts")))
    shape = materialize(parts[0].join(parts[1], ["tree", "leaf"]), "cells")
    both = []
    for side, own, other, is_query in ((placed, "a", "b", False), (asked, "b", "a", True)):
        cut = side.join(shape, ["tree", "leaf"]).select(
            "tree", "leaf", F.pmod(F.xxhash64("id"), F.col(f"{own}_parts")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)).alias(other),
            F.lit(is_query).alias("asked"), "id", "vector")
        both.append(cut.select("tree", "leaf", "a", "b", "asked", "id", "vector"))
    return both[0].union(both[1])


def _found(placed: DataFrame, asked: DataFrame, best: int) -> DataFrame:
    """``(rep, vec_id, score, place)``: the best rows in the leaves that each query opens."""
    cells = _cells(placed, asked).repartition("tree", "leaf", "a", "b").sortWithinPartitions("tree", "leaf", "a", "b", "asked")
    found = cells.mapInArrow(lambda batches: _search(batches, best), "rep long, vec_id long, score double")
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return materialize(
        found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= best), "nearest")


def nearest(vectors: DataFrame, queries: Column, vector: str = "embedding", key: str = "vec_id",
            nearest: int = NEAREST, leaves: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's nearest others by cosine; ``leaves`` sets the effort unmeasured.

    Queries that found fewer than they should open more leaves, in the end all of them.
    """
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = good.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), queries.alias("asked")).distinct()
    # One more copy than asked for, as a query may be one of them.
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = materialize(rows.withColumn("copy", copy).where(F.col("copy") <= nearest + 1).select("id", "vector"), "vectors")
    count = kept.count()
    trees = fit(kept, count)
    if not trees:
        empty = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)
    width = trees[0].further.shape[1]
    asking = materialize(rows.where("asked").select("id", "vector").where(F.size("vector") == width), "queries")
    kept = kept.where(F.size("vector") == width)
    alike = materialize(asking.groupBy("vector").agg(F.min("id").alias("rep")), "representatives")
    leaves = leaves or effort(kept, alike.select(F.col("rep").alias("id"), "vector"), trees, nearest)
    placed = materialize(_placed(kept, trees, None), "placed")
    reps = alike.select(F.col("rep").alias("id"), "vector")
    every = sum(len(t.border) + 1 << len(t.further) for t in trees)
    enough = min(nearest + 1, kept.count())
    rounds = []
    while True:
        rounds.append(_found(placed, materialize(_placed(reps, trees, leaves), "asked"), nearest + 1))
        if leaves >= every:
            break
        full = rounds[-1].where(F.col("place") == enough).select(F.col("rep").alias("id"))
        reps = materialize(reps.join(full, "id", "left_anti"), "short")
        if reps.isEmpty():
            break
        leaves = min(every, 4 * leaves)
    # A query's later rounds hold what its earlier ones found, and more.
    of_rep = rounds[0].drop("place") if len(rounds) == 1 else reduce(DataFrame.union, rounds).groupBy("rep", "vec_id").agg(
        F.max("score").alias("score"))
    each = asking.join(alike, "vector").select(F.col("id").alias("query_id"), "rep")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (each.join(of_rep, "rep").where("vec_id <> query_id").withColumn("rank", rank)
            .where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score"))
