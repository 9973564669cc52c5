import random

import pytest

from firstpast.operators import ranges


def run(spark, rows):
    df = spark.createDataFrame(rows, "provider string, slot long, shred_index long, rx_ns long, data_complete boolean")
    return sorted((r.provider, r.slot, r.range_start, r.range_end, r.ready_ns) for r in ranges.completed_ranges(df).collect())


def brute(rows):
    out = []
    for key in sorted({r[:2] for r in rows}):
        first, ends = {}, set()
        for _, _, i, rx, fin in (r for r in rows if r[:2] == key):
            first[i] = min(rx, first.get(i, rx))
            if fin:
                ends.add(i)
        start = 0
        for end in sorted(ends):
            if all(i in first for i in range(start, end + 1)):
                out.append((*key, start, end, max(first[i] for i in range(start, end + 1))))
            start = end + 1
    return out


def test_rows_after_the_last_boundary_are_never_emitted(spark):
    assert run(spark, [("p", 1, 0, 5, False), ("p", 1, 1, 3, True), ("p", 1, 2, 9, False)]) == [("p", 1, 0, 1, 5)]


def test_gap_blocks_only_its_own_range(spark):
    rows = [("p", 1, 0, 5, True), ("p", 1, 2, 6, True), ("p", 1, 3, 7, True)]
    assert run(spark, rows) == [("p", 1, 0, 0, 5), ("p", 1, 3, 3, 7)]


@pytest.mark.parametrize("block", [4, 1 << 16])
@pytest.mark.parametrize("seed", range(3))
def test_matches_a_scan(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ranges, "_BLOCK", block)
    rng = random.Random(seed)
    rows = [(p, s, i, rng.randrange(1000), rng.random() < 0.3) for p in "pq" for s in (1, 2)
            for i in range(40) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    assert run(spark, rows) == brute(rows)


def test_readable_when_the_range_is_complete(spark):
    done = spark.createDataFrame([("p", 1, 0, 3, 4, 50), ("q", 1, 0, 3, 4, 70)],
                                 "provider string, slot long, range_start long, range_end long, packets long, ready_ns long")
    tx = spark.createDataFrame([("t", 1, 4), ("u", 1, 9)], "signature string, slot long, range_end_exclusive long")
    got = sorted((r.signature, r.provider, r.ready_ns) for r in ranges.txn_readable_at(tx, done).collect())
    assert got == [("t", "p", 50), ("t", "q", 70)]
