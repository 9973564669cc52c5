"""Baseline and transaction races, percentiles, head-to-head."""

import random

import pytest
from pyspark.sql import functions as F

from firstpast.operators import h2h, percentiles, race, stats, txns

ARRIVAL = "hub string, slot long, fec_set_index long, source string, delta_ns long, signature string"


def arrivals(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], ARRIVAL)


def test_first_arrival_counts_and_ties_go_by_name(spark):
    df = arrivals(spark, ("h", 1, 0, "b", 5), ("h", 1, 0, "a", 5), ("h", 1, 0, "b", 1), ("h", 1, 0, "b", 1),
                  ("h", 1, 0, "c", 1), ("h", 1, 0, "d", None))
    got = [(r.source, r.delta_ns, r.rank) for r in race.ranked_races(df).orderBy("rank").collect()]
    assert got == [("b", 1, 0), ("c", 1, 1), ("a", 5, 2)]


def test_lone_finisher_wins_a_baseline_race(spark):
    ranked = race.ranked_races(arrivals(spark, ("h", 1, 0, "a", -3)))
    row = stats.per_source_stats(ranked).first()
    assert (row.win_count, row.win_rate_pct, row.coverage_pct, row.beats_baseline_pct) == (1, 100.0, 100.0, 100.0)


def test_percentile_is_the_midpoint_of_a_clamped_bin(spark):
    df = spark.createDataFrame([("a", d) for d in (0, 19_999, 20_000, 10**12, -10**12)], "source string, d long")
    got = percentiles.binned_percentile(df, ["source"], "d", {"p0": 0.01, "p50": 0.5, "p100": 1.0}).first()
    assert got.p0 == pytest.approx(-99.99) and got.p50 == pytest.approx(0.01) and got.p100 == pytest.approx(99.99)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_rank_matches_sorting(spark, seed):
    rng = random.Random(seed)
    values = {s: [rng.choice([0, 7, rng.randrange(2**40), rng.randrange(2**62)]) for _ in range(rng.randrange(1, 200))]
              for s in "abc"}
    df = spark.createDataFrame([(s, v) for s, vs in values.items() for v in vs], "source string, v long")
    quantiles = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    for row in percentiles.nearest_rank(df, ["source"], "v", quantiles).collect():
        ordered = sorted(values[row.source])
        assert [row[q] for q in quantiles] == [ordered[int((len(ordered) - 1) * p)] for p in quantiles.values()]


def test_nearest_rank_of_three(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3)], "s string, v long")
    assert percentiles.nearest_rank(df, ["s"], "v", {"p90": 0.9}).first().p90 == 2


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_count_before_is_the_same_for_any_block_width(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("xy"), t, s, rng.randrange(1, 5)) for t in rng.sample(range(-60, 60), 50) for s in "ab"]
    df = spark.createDataFrame(rows, "k string, t long, s string, n long")
    block = F.floor(F.col("t") / F.lit(float(width)))
    for r in race.count_before(df, ["k"], ["t", "s"], block, "n").collect():
        assert r.before == sum(n for k, t, s, n in rows if k == r.k and (t, s) < (r.t, r.s))


def test_signature_panel_ranks_valid_rows_only(spark):
    df = arrivals(spark, ("h", 1, 0, "base", 0, "S"), ("h", 1, 0, "a", -5, "X"), ("h", 1, 0, "a", -4, "S"),
                  ("h", 1, 0, "a", -4, "S"), ("h", 1, 0, "b", 3, None), ("h", 1, 0, "b", 4, ""),
                  ("h", 2, 0, "a", -9, "S"))
    got = {r.source: r for r in stats.signature_panel(df, ["base"]).collect()}
    assert (got["a"].valid_samples, got["a"].win_count, got["a"].avg_rank, got["a"].bad_sig_count) == (2, 1, 0.5, 1)
    assert (got["base"].avg_rank, got["base"].win_rate_pct) == (2.0, 0.0)
    assert (got["b"].valid_samples, got["b"].avg_rank, got["b"].no_sig_count) == (0, None, 2)
    assert sorted(r.source for r in stats.signature_mismatches(stats.signature_panel(df, ["base"])).collect()) == ["a", "b"]


def test_two_baseline_rows_do_not_double_arrivals(spark):
    df = arrivals(spark, ("h", 1, 0, "base", 0, "S"), ("h", 1, 0, "base2", 0, "R"), ("h", 1, 0, "a", 2, "S"))
    got = {r.source: r for r in stats.signature_panel(df, ["base", "base2"]).collect()}
    assert (got["a"].valid_samples, got["a"].bad_sig_pct_of_arrivals) == (1, 0.0)


def test_head_to_head_counts_pairs(spark):
    ranked = race.ranked_races(arrivals(
        spark, ("h", 1, 0, "a", 1), ("h", 1, 0, "b", 2), ("h", 2, 0, "b", 1), ("h", 2, 0, "a", 2),
        ("h", 3, 0, "a", 1), ("h", 3, 0, "b", 5), ("h", 3, 0, "c", 9), ("h", 4, 0, "a", 0)))
    pairs = {(r.source_a, r.source_b): (r.both_present, r.a_first_count) for r in h2h.head_to_head(ranked).collect()}
    assert pairs == {("a", "b"): (3, 2), ("b", "a"): (3, 1), ("a", "c"): (1, 1), ("b", "c"): (1, 1)}
    long = h2h.h2h_matrix_long(h2h.head_to_head(ranked))
    cells = {(r.row_source, r.col_source): (r.beats_pct, r.band) for r in long.collect()}
    assert cells["c", "a"] == (0.0, "bad") and cells["a", "b"] == (pytest.approx(66.6667, abs=1e-3), "good")
    matrix = h2h.h2h_matrix(long, ["a", "b", "c"]).collect()
    assert [r.row_source for r in matrix] == ["a", "b", "c"]
    assert matrix[0].b == 66.7 and matrix[0].a is None


def test_earlier_bucket_takes_the_race(spark):
    rows = [("h", 1, 0, "a", 5, "2024-01-01 00:59:00"), ("h", 1, 0, "a", 1, "2024-01-01 01:01:00"),
            ("h", 1, 0, "b", 2, "2024-01-01 01:02:00"), ("h", 2, 0, "b", 2, "2024-01-01 01:02:00"),
            # an empty hour in between: still counted once, in its first hour
            ("h", 1, 0, "c", 0, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "hub string, slot long, fec_set_index long, source string, delta_ns long, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    got = sorted((r.slot, r.source, r.delta_ns) for r in race.first_bucket_arrivals(df, "1 hour").collect())
    assert got == [(1, "a", 5), (2, "b", 2)]
    assert race.first_bucket_only(df, "1 hour").count() == 2


# -- transactions --------------------------------------------------------------

def sightings(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, signature string, ns long, slot long")


def test_redelivery_does_not_move_the_first_sighting(spark):
    row = txns.txn_race(sightings(spark, ("0", "s", 1000, 1), ("0", "s", 5000, 1))).first()
    assert (row.seen, row.contested, row.winrate) == (1, 0, None)


def test_behind_and_wins(spark):
    events = sightings(spark, ("0", "s", 1000, 1), ("1", "s", 3000, 1))
    got = {r.source: r for r in txns.txn_race(events).collect()}
    assert (got["0"].wins, got["1"].wins, got["1"].behind_mean_us) == (1, 0, 2.0)
    pct = {r.source: r.behind_p50_us for r in txns.txn_percentiles(events).collect()}
    assert pct == {"0": 0.0, "1": 2.0}


def test_ties_all_win(spark):
    got = txns.txn_race(sightings(spark, ("0", "s", 7, 1), ("1", "s", 7, 1))).collect()
    assert [r.winrate for r in got] == [1.0, 1.0] and got[0].contested_signatures == 1


TXNS = [("s1", ["a", "b"], False, False), ("s2", ["b", "c"], True, False), ("s3", ["c"], False, True), ("", ["a"], False, False)]


@pytest.mark.parametrize("limits, expected", [
    ({}, {"s1", "s2", "s3", ""}), ({"include": ["a", "c"]}, {"s1", "s2", "s3", ""}), ({"exclude": ["c"]}, {"s1", ""}),
    ({"required": ["b", "c"]}, {"s2"}), ({"vote": False, "failed": False}, {"s1", ""}), ({"signature": "s3"}, {"s3"})])
def test_filters(spark, limits, expected):
    df = spark.createDataFrame(TXNS, "signature string, account_keys array<string>, is_vote boolean, failed boolean")
    assert {r.signature for r in txns.filter_txns(df, **limits).collect()} == expected


def test_watched_wallet_skips_unsigned_and_repeats(spark):
    df = spark.createDataFrame([("s1", ["w"], 5, 30), ("s1", ["w"], 5, 20), ("", ["w"], 5, 1), ("s2", ["x"], 5, 1)],
                               "signature string, account_keys array<string>, slot long, at long")
    assert [r[:] for r in txns.watch(df, "w", "at").collect()] == [("s1", 5, 20)]


def test_landing_distance(spark):
    triggers = spark.createDataFrame([(s, 100, 0) for s in "abcd"], "signature string, trigger_slot long, sent_ns long")
    landed = spark.createDataFrame([("a", 103, 10**9, False), ("b", 104, 10**9, True), ("c", 105, 61 * 10**9, False)],
                                   "signature string, landed_slot long, landed_ns long, failed boolean")
    got = {r.signature: r.distance for r in txns.landing_distance(triggers, landed).collect()}
    assert got == {"a": 3, "b": None, "c": None, "d": None}


@pytest.mark.parametrize("block", [10, 37, 640])
@pytest.mark.parametrize("seed", range(2))
def test_throttle_matches_a_scan(spark, seed, block):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(0, 900)) for k in "ab" for _ in range(120)] + [("c", 3)]
    df = spark.createDataFrame(rows, "k string, at_ns long")
    last = spark.createDataFrame([("b", 45)], "k string, last_at long")
    got = sorted(r[:] for r in txns.throttle(df, "k", "at_ns", 10, start=5, last=last, block=block).collect())
    want = []
    for key, begin in (("a", 5), ("b", 45), ("c", 5)):
        for t in sorted({t for k, t in rows if k == key}):
            if t >= begin + 10:
                want.append((key, t))
                begin = t
    assert got == sorted(want)


@pytest.mark.parametrize("fan", [2, 5, 32])
def test_throttle_of_one_key_over_many_blocks(spark, fan):
    """One key holds nearly all rows, some blocks are empty, levels are composed and entered in small groups."""
    rng = random.Random(fan)
    at = [("hot", t) for t in rng.sample(range(20_000), 4000) if t // 700 % 3] + [("cold", 17), ("cold", 19_999), (None, 40)]
    df = spark.createDataFrame(at, "k string, at_ns long")
    got = sorted((r[:] for r in txns.throttle(df, "k", "at_ns", 13, block=29, fan=fan).collect()), key=repr)
    want = []
    for k in ("hot", "cold"):
        allowed = 13
        for t in sorted(t for name, t in at if name == k):
            if t >= allowed:
                want.append((k, t))
                allowed = t + 13
    assert [r for r in got if r[0]] == sorted(want, key=repr)


def test_step_functions_compose_in_any_bracketing():
    rng = random.Random(3)
    for _ in range(400):
        gap, width, n = rng.randint(1, 30), rng.randint(1, 60), rng.randint(2, 8)
        at = sorted({rng.randrange(n * width) for _ in range(rng.randint(1, 50))})
        spans = [(k, [t for t in at if t // width == k]) for k in range(n)]
        spans = [(k * width, txns._steps(b, gap, k * width)) for k, b in spans if b]
        left = []
        for _, steps in spans:
            left = txns._then(left, steps, gap, 0)
        while len(spans) > 1:
            k = rng.randrange(len(spans) - 1)
            (opens, x), (_, y) = spans[k:k + 2]
            spans[k:k + 2] = [(opens, txns._then(x, y, gap, opens))]
        for allowed in range(gap + 1):
            last, a = None, allowed
            for t in at:
                if t >= a:
                    last, a = t, t + gap
            assert txns._last_action(left, allowed) == last == txns._last_action(spans[0][1], allowed)
