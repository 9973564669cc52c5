"""SimHash near-duplicates: fingerprints, pivot distance tables, linked components.

The fingerprint of a text has a bit set where more than half of the XXH64
hashes (seed 42) of its three-word shingles, repeats included, have it set. Texts link at ``RADIUS`` or
fewer differing bits, and a component is all that links reach.

How pairs are found, over distinct fingerprints only:

1. Two fingerprints that differ in at most 3 bits agree wholly in at least 3 of 6
   blocks of bits. Each fingerprint goes into the 20 buckets of its block triples,
   so no pair is missed, and a bucket's key has about 32 bits.
2. A bucket of more than ``BUCKET`` fingerprints is split again the same way by the
   32 bits its key leaves free. What agrees in that key too leaves at most 18 bits
   free, which bounds a sub-bucket at 2^18 members however many rows there are.
3. In a bucket, a table of the Hamming distances to ``PIVOTS`` reference
   fingerprints discards pairs: by the triangle inequality, no coordinate of a
   link differs by more than the radius. Survivors are verified. Pairs that
   earlier links of the bucket already connect are not looked at again, and a
   bucket returns a spanning forest, never its pairs.

A table of distances alone cannot be dealt out to tasks without comparing
everything with everything, which is why the buckets come first.

Defined cases: NULL and empty texts have fingerprint zero and link like any
other; repeated rows share a component; NULL ids take no part in the smallest
id, and a component of NULL ids alone has the id NULL. One row of each component is kept as a
document, also where ids are NULL or stand for several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import components, per_text, unused
from firstpast.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 6
PIVOTS = 32
BUCKET = 4096
# Members of buckets compared at once in a task.
TOGETHER = 1 << 15


def fingerprint(text: str, hashes_at_once: int = 8192) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else iter([words])
    of = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for _ in range(0, total, hashes_at_once):
        some = np.fromiter((of(b" ".join(s), SEED) for s in islice(shingles, hashes_at_once)), np.uint64)
        ones += np.unpackbits(some.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, np.int64)
    bits = np.packbits((2 * ones > total), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``also`` and ``print``, the fingerprint as a signed long."""
    kept = (key, *also)
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return per_text(docs, f"{schema}, print long", lambda: lambda t: (fingerprint(t),), text, kept)


def _block_masks(bits: list[int], blocks: int) -> list[int]:
    """Masks of all block combinations that a link must agree in, over the given bit positions."""
    parts = [sum(1 << b for b in bits[i::blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


MASKS = _block_masks(list(range(64)), BLOCKS)
SUB_MASKS = [_block_masks([b for b in range(64) if not m >> b & 1], BLOCKS) for m in MASKS]


def _buckets(masks: list[int]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for i, m in enumerate(masks)]))


def pivots() -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(PIVOTS)], np.uint64)


def linked(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each member of the buckets laid end to end, the first member of its bucket that links reach."""
    total = len(prints)
    table = np.bitwise_count(prints[:, None] ^ pivots()[None, :]).astype(np.int8)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total) - 1  # members of the bucket after this one
    root = np.arange(total)
    for step in range(1, int(sizes.max(initial=0))):
        a = np.nonzero(left >= step)[0]
        a = a[root[a] != root[a + step]]
        for k in range(table.shape[1]):
            a = a[np.abs(table[a, k] - table[a + step, k]) <= RADIUS]
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]) <= RADIUS]
        for x in a.tolist():
            y = x + step
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while len(a) and not np.array_equal(root, flat := root[root]):
            root = flat
    return root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the members of each bucket as its verified pairs do."""
    for batch in batches:
        lists = batch.column(0)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        prints = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            some = prints[before:ends[stop - 1]]
            root = linked(some, sizes[start:stop])
            found = np.nonzero(root != np.arange(len(some)))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[found].view(np.int64)), pa.array(some[root[found]].view(np.int64))], ["a", "b"])
            start = stop


def links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``print`` that reach whatever pairs within the radius reach."""
    keyed = prints.select("print", _buckets(MASKS).alias("bucket")).select("print", "bucket.*")
    hot = materialize(
        keyed.groupBy("part", "bits").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
        .select("part", "bits"), "hot-buckets")
    cold = keyed.join(hot, ["part", "bits"], "left_anti").groupBy("part", "bits")
    found = cold.agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1).select("prints")
    if not hot.isEmpty():
        again = keyed.join(hot, ["part", "bits"], "left_semi")
        per_part = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in SUB_MASKS])
        sub = again.select("*", F.posexplode(F.element_at(per_part, F.col("part") + 1)).alias("sub", "mask"))
        groups = sub.groupBy("part", "bits", "sub", F.col("print").bitwiseAND(F.col("mask")).alias("more"))
        found = found.union(
            groups.agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1).select("prints"))
    return found.mapInArrow(_verify, "a long, b long")


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(print, root, component_id)`` of every distinct fingerprint of ``(key, print)``.

    ``root`` is one per component, ``component_id`` the smallest key reached.
    """
    distinct = materialize(prints.groupBy("print").agg(F.min(key).alias("lowest")), "distinct-prints")
    reached = components(links(distinct.select("print")), "prints")
    rooted = materialize(
        distinct.join(reached.withColumnRenamed("node", "print"), "print", "left")
        .select("print", "lowest", F.coalesce("root", "print").alias("root")), "rooted-prints")
    lowest = materialize(rooted.groupBy("root").agg(F.min("lowest").alias("component_id")), "component-ids")
    return rooted.join(lowest, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` in hexadecimal, ``component_id``."""
    prints = materialize(fingerprints(docs, text, key), "prints")
    of = materialize(classes(prints, key), "classes")
    return prints.join(of, "print").select(
        key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns: the smallest key, NULL last, then the lowest hash of a row.

    Rows are told apart by two hashes of all their columns, not by the key, which may be NULL or repeated.
    Only rows alike in every column share the hashes; copies of them are dropped before they move.
    """
    one, two = unused(docs, "row_hash"), unused(docs, "row_hash_again")
    # NULL leaves a hash as it is, so whether a value is NULL is hashed too.
    said = [c for name in docs.columns for c in (F.col(name).isNull(), F.col(name))]
    hashed = docs.select("*", F.xxhash64(*said).alias(one), F.xxhash64(F.lit(1), *said).alias(two))
    prints = materialize(fingerprints(hashed, text, key, (one, two)), "prints")
    row = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("id"), F.col(one).alias("one"), F.col(two).alias("two"))
    lowest = prints.groupBy("print").agg(F.min(row).alias("row"))
    kept = materialize(
        classes(prints, key).join(lowest, "print").groupBy("root").agg(F.min("row").alias("row"))
        .select(F.col("row.one").alias(one), F.col("row.two").alias(two)), "kept-rows")
    return hashed.dropDuplicates([one, two]).join(kept, [one, two], "left_semi").select(*docs.columns)
