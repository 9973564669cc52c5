"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A task encodes its documents and lays their pieces into blocks of ``BLOCK`` pieces. What is left over in the tasks is regrouped
across them, so the number of sequences does not follow the layout of the files; nothing
of twice a block or more is ever optimised in one place. Every block is evolved on
``ISLANDS`` islands, each a row of its own that Spark deals out. An epoch ends with
a shuffle that sends every island's elite to the next one. The best packing over a block's
islands is applied to its pieces.

A genome is the list of bins, and its cost counts the bins, then prefers those
whose bins are unevenly filled, since full ones leave room elsewhere. Crossover
injects well-filled bins of one parent into the other, takes out the bins that
now hold a piece twice, and fits what they held besides by best fit, largest
first. A packing as small as the sum of the lengths allows ends the search.

Defined cases: NULL and empty texts are one end token; a document of exactly the
limit is one piece; repeated rows are packed one by one; an empty table gives no
rows. Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstpast.llm.common import arrow_schema, slices
from firstpast.session import materialize

LIMIT = 1024
END = 2
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
OFFSPRING = 6
# Bins a crossover injects, as a part of the parent's bins.
INJECTED = 0.1


# -- tokens --------------------------------------------------------------------

@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The ids of a text under a byte-level BPE vocabulary file; its special strings keep their own ids."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    # Printable bytes stand for themselves, the others for code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def _cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many tokens; only the first may be shorter than the limit."""
    first = (total - 1) % limit + 1
    return [(0, first), *((s, limit) for s in range(first, total, limit))]


_LISTS = ("keys", "pieces", "starts", "lengths", "crcs")


def blocks(docs: DataFrame, path: str, text: str, key: str, limit: int, end: int, with_ids: bool) -> DataFrame:
    """Rows of up to ``BLOCK`` pieces: one number and parallel lists."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"block long, keys array<{kind}>, pieces array<long>, starts array<long>, lengths array<int>, "
              "crcs array<long>" + ", ids array<binary>" * with_ids)
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            columns = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([list(c)], f.type) for c, f in zip(columns, list(fields)[1:]))],
                schema=fields)

        for batch in slices(batches):
            for one, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(said or ""), end], "<u4")
                for k, (start, length) in enumerate(_cut(len(ids), limit)):
                    data = ids[start:start + length].tobytes()
                    held.append((one, k, start, length, zlib.crc32(data), *[data][:with_ids]))
                    if len(held) == BLOCK:
                        yield block()
                        held.clear()
                        number += 1
        if held:
            yield block()

    return docs.select(key, text).mapInArrow(task, schema)


def regrouped(laid: DataFrame) -> DataFrame:
    """Full blocks as they are, and the unfilled ones, one per reading task, gathered into blocks of ``BLOCK`` to less than twice that."""
    lists = [c for c in laid.columns if c != "block"]
    unfilled = laid.where(F.size("lengths") < BLOCK)
    # Numbers only: a row per task that read documents.
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    groups = (unfilled.select("block", F.size("lengths").alias("n"))
              .select("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK).alias("group")))
    held = (unfilled.join(groups, "block").groupBy("group")
            .agg(F.array_sort(F.collect_list(F.struct("block", *lists))).alias("every")))
    # A field of an array of structs is the array of that field.
    merged = held.select(F.col("every")[0]["block"].alias("block"), *[F.flatten(F.col("every")[c]).alias(c) for c in lists])
    return laid.where(F.size("lengths") == BLOCK).unionByName(materialize(merged, "gathered-blocks"))


# -- evolution -----------------------------------------------------------------

Bins = list[tuple[int, ...]]


class Packer:
    """Bins of one block under genetic operators. Pieces are numbers into ``lengths``."""

    def __init__(self, lengths: list[int], limit: int, seed: int):
        self.lengths, self.limit = lengths, limit
        self.random = random.Random(seed)
        self.loose = [i for i, n in enumerate(lengths) if n < limit]
        self.least = -(-sum(lengths[i] for i in self.loose) // limit)

    def fit(self, bins: Bins, pieces: list[int]) -> Bins:
        """Add the pieces, largest first, each to the fullest bin that it fits."""
        lengths, limit = self.lengths, self.limit
        grown = [list(b) for b in bins]
        by_room: list[list[int]] = [[] for _ in range(limit + 1)]
        mask = 0  # bit r is set if a bin with room r exists
        for k, b in enumerate(grown):
            room = limit - sum(lengths[i] for i in b)
            by_room[room].append(k)
            mask |= 1 << room
        for i in sorted(pieces, key=lengths.__getitem__, reverse=True):
            need = lengths[i]
            rooms = mask >> need
            if rooms:
                room = need + (rooms & -rooms).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
                grown[k].append(i)
            else:
                room, k = limit, len(grown)
                grown.append([i])
            by_room[room - need].append(k)
            mask |= 1 << room - need
        return [tuple(b) for b in grown]

    def fill(self, one: tuple[int, ...]) -> int:
        return sum(map(self.lengths.__getitem__, one))

    def cost(self, bins: Bins) -> tuple[int, float]:
        return len(bins), -sum(self.fill(b) ** 2 for b in bins)

    def cross(self, into: Bins, of: Bins) -> Bins:
        """``into`` with some well-filled bins of ``of``."""
        ranked = sorted(of, key=self.fill, reverse=True)
        count = max(1, round(INJECTED * len(of)))
        injected = self.random.sample(ranked[:max(count, len(ranked) // 2)], count)
        inside = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in into:
            if inside.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in inside]
        return self.fit(kept + injected, displaced)

    def mutate(self, bins: Bins) -> Bins:
        """Empty the least filled bins and some others, and fit their pieces anew."""
        ranked = sorted(bins, key=self.fill)
        few = max(1, len(ranked) // 20)
        freed = ranked[:few] + self.random.sample(ranked[few:], min(few, len(ranked) - few))
        gone = set(freed)
        return self.fit([b for b in bins if b not in gone], [i for b in freed for i in b])

    def seeds(self) -> list[Bins]:
        """Best fit, largest first, and the same after random bins' worth of pieces were placed first."""
        made = [self.fit([], self.loose)]
        while len(made) < POPULATION and len(made[0]) > self.least:
            some = set(self.random.sample(self.loose, len(self.loose) // 10))
            made.append(self.fit(self.fit([], [i for i in self.loose if i in some]),
                                 [i for i in self.loose if i not in some]))
        return made

    def evolve(self, population: list[Bins]) -> Bins:
        population = sorted(population, key=self.cost)
        for _ in range(OFFSPRING):
            if len(population[0]) <= self.least:
                break
            a, b = (self.random.choice(population) for _ in range(2))
            child = self.cross(a, b) if a is not b else self.mutate(a)
            population = sorted([*population, child], key=self.cost)[:POPULATION]
        return population[0]

    def genome(self, bins: Bins) -> np.ndarray:
        """The bin of every piece; whole pieces have bins of their own after the others."""
        of = np.full(len(self.lengths), -1, np.int32)
        for k, b in enumerate(bins):
            of[list(b)] = k
        whole = of < 0
        of[whole] = len(bins) + np.arange(whole.sum())
        return of

    def bins(self, genome: np.ndarray) -> Bins:
        found: dict[int, list[int]] = {}
        for i in self.loose:
            found.setdefault(int(genome[i]), []).append(i)
        return [tuple(b) for b in found.values()]


_ISLAND = "block long, island int, lengths array<int>, genome array<int>, n_bins int, cost double"


def _evolved(rows: DataFrame, limit: int, epoch: int) -> DataFrame:
    """One epoch of every island. Rows: block, island, lengths, genomes to start from (none: seeds)."""
    fields = arrow_schema(_ISLAND)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block, island, lengths, genomes = (c.to_pylist()[0] for c in batch.columns)
            packer = Packer(lengths, limit, hash((block, island, epoch)))
            best = packer.evolve([packer.bins(np.array(g)) for g in genomes] or packer.seeds())
            n, cost = packer.cost(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((block, island, lengths, packer.genome(best), n, float(cost)), fields)],
                schema=fields)

    return rows.select("block", "island", "lengths", "genomes").mapInArrow(task, _ISLAND)


def packings(laid: DataFrame, limit: int = LIMIT, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``(block, genome)``: the best packing of every block over its islands."""
    start = laid.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "lengths")
    rows = start.withColumn("genomes", F.array().cast("array<array<int>>"))
    for epoch in range(epochs):
        state = materialize(_evolved(rows, limit, epoch), "islands")
        moved = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        rows = state.union(moved).groupBy("block", "island").agg(
            F.first("lengths").alias("lengths"), F.collect_set("genome").alias("genomes"))
    return state.groupBy("block").agg(F.min_by("genome", F.struct("n_bins", "cost", "island")).alias("genome"))


# -- result --------------------------------------------------------------------

def pack(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT,
         end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[key].dataType.simpleString()
    laid = regrouped(materialize(blocks(docs, path, text, key, limit, end, with_ids), "blocks"))
    best = packings(laid, limit)
    schema = (f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
              + ", ids array<long>" * with_ids)
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            block, genome, *lists = (c[0] for c in batch.columns)
            pieces, starts, lengths, crcs = (x.values.to_numpy(zero_copy_only=False) for x in lists[1:5])
            bins = genome.values.to_numpy(zero_copy_only=False)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order], dtype=np.int64)
            opens = np.r_[True, bins[order][1:] != bins[order][:-1]]
            base = np.maximum.accumulate(np.where(opens, ends - lengths[order], 0))
            offset = np.empty(len(bins), np.int64)
            offset[order] = ends - lengths[order] - base
            columns = [lists[0].values, pieces, starts, lengths, crcs, block.as_py() * 2 * BLOCK + bins.astype(np.int64),
                       offset]
            columns += [[np.frombuffer(x, "<u4").astype(np.int64) for x in lists[5].as_py()]] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)],
                schema=fields)

    return laid.join(best, "block").select("block", "genome", *_LISTS, *["ids"][:with_ids]).mapInArrow(task, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of a packing made with its ids; a sequence holds a bounded number of tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
