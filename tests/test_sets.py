"""Set rows: small hand-written captures with the exact row each must give."""

import pytest
from pyspark.sql import functions as F

from firstpast import schema
from firstpast.operators import sets

TRUE_DATA, OTHER_DATA, CODE_DATA = "A", "B", "C"


def shred(provider=0, slot=100, fec=0, pos=0, rx=1000, data=TRUE_DATA, *, code=False, ok=True, merkle=True,
          complete=False, k=None, m=None, payload=None, last=False):
    return {
        "provider": f"p{provider}", "rx_ns": rx, "slot": slot, "fec_set_index": fec,
        "shred_index": fec + pos, "is_code": code, "position": pos, "last_in_slot": last,
        "data_complete": complete, "num_data": k, "num_coding": m, "leader": None, "sig_ok": ok,
        "merkle_ok": merkle, "data_hash": data,
        "payload_hash": payload or f"{provider}/{fec}/{pos}/{code}/{rx}/{data}/{ok}",
    }


def coding(provider=0, pos=0, rx=1000, k=1, m=1, **more):
    return shred(provider, pos=pos, rx=rx, data=CODE_DATA, code=True, k=k, m=m, **more)


def rows(spark, *shreds):
    df = spark.createDataFrame([tuple(s[c] for c in schema.columns("shreds")) for s in shreds], schema.of("shreds"))
    out = sets.set_rows(df)
    assert out.columns == schema.columns("fec_sets")
    return {(r.provider, r.slot, r.fec_set_index): r for r in out.collect()}


def split(row):
    return row.invalid, row.invalid_sig, row.invalid_data, row.invalid_unknown


GOOD = shred(0, pos=3, rx=1000)


@pytest.mark.parametrize("bad, expected", [
    (shred(1, pos=3, rx=1100, ok=False), (1, 1, 0, 0)),                      # same data, broken proof
    (shred(1, pos=3, rx=1100, data=OTHER_DATA, ok=False), (1, 0, 1, 0)),     # different data
    (shred(1, pos=3, rx=1100, data=None, ok=False), (1, 0, 0, 1)),           # no content to compare
    (shred(1, pos=3, rx=1100, merkle=False, ok=None), (1, 1, 0, 0)),         # no root at all
], ids=["broken proof", "altered data", "no content hash", "no root"])
def test_invalid_split(spark, bad, expected):
    row = rows(spark, GOOD, bad)["p1", 100, 0]
    assert split(row) == expected
    assert not row.is_valid


def test_no_truth_is_unknown(spark):
    assert split(rows(spark, shred(1, pos=3, ok=False))["p1", 100, 0]) == (1, 0, 0, 1)


def test_truth_may_come_later(spark):
    late = shred(0, pos=3, rx=1200)
    assert split(rows(spark, shred(1, pos=3, rx=1100, ok=False), late)["p1", 100, 0]) == (1, 1, 0, 0)


def test_code_copy_is_no_truth_for_data(spark):
    row = rows(spark, shred(0, pos=3), coding(0, pos=3), shred(1, pos=3, rx=1100, ok=False))["p1", 100, 0]
    assert split(row) == (1, 1, 0, 0)


def test_split_sums_to_invalid(spark):
    row = rows(spark, shred(0, pos=0), shred(0, pos=1),
               shred(1, pos=0, ok=False), shred(1, pos=1, data=OTHER_DATA, ok=False),
               shred(1, pos=2, ok=False))["p1", 100, 0]
    assert split(row) == (3, 1, 1, 1)


def test_data_only_provider_decodes(spark):
    row = rows(spark, *[shred(pos=i, rx=1000 + i, complete=i == 3) for i in range(4)])["p0", 100, 0]
    assert (row.n_data, row.n_code, row.decode_ns, row.is_valid) == (4, 0, 1003, True)
    assert row.expected_total is None and row.missed == 0


def test_early_invalid_does_not_move_first(spark):
    row = rows(spark, shred(pos=0, rx=100, ok=False), shred(pos=1, rx=200))["p0", 100, 0]
    assert (row.first_ns, row.last_ns, row.invalid) == (200, 200, 1)


def test_all_invalid_falls_back_to_creation(spark):
    row = rows(spark, shred(pos=0, rx=100, ok=False), shred(pos=1, rx=200, ok=False))["p0", 100, 0]
    assert (row.first_ns, row.last_ns, row.decode_ns) == (100, 100, None)


def test_kth_arrival(spark):
    row = rows(spark, shred(rx=1000), coding(rx=1100, k=1))["p0", 100, 0]
    assert (row.first_ns, row.decode_ns, row.last_ns, row.is_valid) == (1000, 1000, 1100, True)
    assert (row.expected_total, row.missed) == (2, 0)


def test_size_learned_late(spark):
    row = rows(spark, *[shred(pos=i, rx=1000 + i) for i in range(3)], coding(rx=5000, k=3))["p0", 100, 0]
    assert (row.decode_ns, row.is_valid) == (1002, True)


def test_size_from_the_first_of_the_two_kinds(spark):
    # The flagged data packet came first, so the coding count stays unknown.
    row = rows(spark, shred(pos=1, rx=900, complete=True), coding(rx=1000, k=7, m=9))["p0", 100, 0]
    assert row.expected_total is None and row.decode_ns == 1000


def test_zero_or_missing_k_never_decodes(spark):
    assert rows(spark, coding(k=0))["p0", 100, 0].decode_ns is None
    assert rows(spark, coding(k=3))["p0", 100, 0].missed == 3
    assert rows(spark, shred())["p0", 100, 0].decode_ns is None


def test_duplicate_never_moves_a_timestamp(spark):
    row = rows(spark, shred(rx=500, payload="x"), shred(rx=9999, payload="x"))["p0", 100, 0]
    assert (row.duplicated, row.last_ns, row.n_data) == (1, 500, 1)


def test_repeated_invalid_is_one_invalid(spark):
    row = rows(spark, shred(rx=500, payload="x", ok=False), shred(rx=600, payload="x", ok=False))["p0", 100, 0]
    assert (row.duplicated, row.invalid) == (1, 1)


def test_no_leader_is_unverifiable(spark):
    row = rows(spark, shred(ok=None, complete=True))["p0", 100, 0]
    assert (row.sig_unverifiable, row.invalid, row.is_valid, row.n_data) == (1, 0, False, 0)


def test_providers_are_isolated(spark):
    assert set(rows(spark, shred(0), shred(1))) == {("p0", 100, 0), ("p1", 100, 0)}


def test_positions_beyond_the_set_do_not_count(spark):
    row = rows(spark, shred(pos=128), shred(pos=0, complete=True))["p0", 100, 0]
    assert (row.n_data, row.decode_ns) == (1, 1000)


def test_acceptance_is_three_valued(spark):
    cases = [(True, True), (True, None), (True, False), (False, True), (False, None)]
    df = spark.createDataFrame(cases, "merkle_ok boolean, sig_ok boolean")
    got = [r[0] for r in df.select(sets.acceptance()).collect()]
    assert got == ["ok", "unverifiable", "bad", "bad", "bad"]


def test_leaders_keep_their_names(spark):
    one, two = shred(0, slot=1), shred(0, slot=2)
    late = dict(shred(0, slot=1, pos=1), leader="val-1")
    got = rows(spark, one, late, dict(two, leader="val-2"), shred(0, slot=3))
    assert {k[1]: r.leader for k, r in got.items()} == {1: "val-1", 2: "val-2", 3: None}


def test_content_ties_and_names(spark):
    """The last authenticated copy is the truth; of equal times the higher payload's."""
    df = spark.createDataFrame([tuple(s[c] for c in schema.columns("shreds")) for s in (
        shred(0, pos=3, rx=5, data="aa", payload="ff"), shred(2, pos=3, rx=5, data="bb", payload="0f"),
        shred(1, pos=3, rx=9, data="aa", ok=False), shred(1, pos=3, rx=9, data="bb", ok=False, payload="z"),
        shred(1, pos=4, rx=9, data=None, ok=False))], schema.of("shreds"))
    got = sets.name_data(sets.match_truth(sets.judged(df)), df).collect()
    assert {(r.shred_index, r.data_hash, r.true_hash, r.failure) for r in got} == {
        (3, "aa", "aa", "invalid_sig"), (3, "bb", "aa", "invalid_data"), (4, None, None, "invalid_unknown")}


@pytest.mark.parametrize("order", [1, -1])
def test_packed_numbers_sort_like_tuples(spark, order):
    """Times up to the largest, parts at both ends of their ranges, ties settled by the parts in turn."""
    import itertools
    from firstpast.functions.numeric import packed, time_of, unpacked
    rows_ = list(itertools.product([0, 1, 1_700_000_000_000_000_000, (1 << 63) - 1], [0, 1, 1 << 56], [0, 2]))[::order]
    df = spark.createDataFrame(rows_, "t long, a long, b long")
    number = packed("t", (F.col("a"), (1 << 56) + 1), (F.col("b"), 3))
    out = df.withColumn("n", number).withColumn("t_", time_of("n"))
    out = out.select("*", *[c.alias(x) for c, x in zip(unpacked("n", (1 << 56) + 1, 3), "xy")]).orderBy("n").collect()
    assert [(r.t, r.a, r.b) for r in out] == sorted(rows_)
    assert all((r.t, r.a, r.b) == (r.t_, r.x, r.y) for r in out)


def test_rest_behind_a_known_time(spark):
    """The subtraction gives what the division gave, also before 1970 and at the last time."""
    from firstpast.functions.numeric import leading_bytes, packed, parts_of, rest_of
    rows_ = [(t, a, b) for t in (-5, 0, (1 << 63) - 1) for a in (0, (1 << 56)) for b in (0, 2)]
    df = spark.createDataFrame(rows_, "t long, a long, b long").withColumn("n", packed("t", (F.col("a"), (1 << 56) + 1), (F.col("b"), 3)))
    parts = parts_of(rest_of("n", "t"), (1 << 56) + 1, 3)
    assert all((r.a, r.b) == (r.x, r.y) for r in df.select("a", "b", parts[0].alias("x"), parts[1].alias("y")).collect())
    texts = spark.createDataFrame([("\u00e9\u00e9tail",), ("a",), ("0123456789",)], "s string").select("s", leading_bytes("s", 3).alias("n"))
    assert all(r.n == int.from_bytes(r.s.encode()[:3].ljust(3, b"\0"), "big") for r in texts.collect())


# -- contested scoreboard ------------------------------------------------------

def set_row(provider, fec, decode, valid=True):
    return (f"p{provider}", 100, fec, decode, valid)


def board(spark, *rows_):
    df = spark.createDataFrame(list(rows_), "provider string, slot long, fec_set_index long, decode_ns long, is_valid boolean")
    return {r.provider: r for r in sets.contested_scoreboard(df).collect()}


def test_faster_wins(spark):
    got = board(spark, set_row(0, 0, 1_000_000), set_row(1, 0, 1_500_000))
    assert (got["p0"].winrate, got["p1"].winrate) == (1.0, 0.0)
    assert (got["p0"].mean_behind_us, got["p1"].mean_behind_us) == (0.0, 500.0)
    assert got["p0"].coverage == got["p1"].coverage == 1.0


def test_tied_both_win(spark):
    got = board(spark, set_row(0, 0, 2_000_000), set_row(1, 0, 2_000_000))
    assert got["p0"].winrate == got["p1"].winrate == 1.0


def test_solo_is_no_race(spark):
    got = board(spark, set_row(0, 0, 1_000), set_row(1, 0, 2_000), set_row(0, 1, 5_000))
    assert (got["p0"].races, got["p0"].present, got["p0"].mean_behind_us) == (1, 2, 0.0)
    assert (got["p0"].contested_sets, got["p0"].total_sets) == (1, 2)


def test_invalid_presence_counts_but_does_not_race(spark):
    got = board(spark, set_row(0, 0, 1_000), set_row(1, 0, 500, valid=False))
    assert (got["p1"].present, got["p1"].valid, got["p1"].winrate, got["p1"].contested_sets) == (1, 0, None, 0)
    ordered = sets.order_scoreboard(spark.createDataFrame(
        [("a", None, 1.0), ("b", 0.2, 0.1), ("c", 0.2, 0.9)], "provider string, winrate double, coverage double"))
    assert [r.provider for r in ordered.collect()] == ["c", "b", "a"]


# -- live (anchored) semantics -------------------------------------------------

def live(spark, baseline, *shreds):
    rooted = [dict(s, root="r" if s["merkle_ok"] else None) for s in shreds]
    columns = [*schema.columns("shreds"), "root"]
    df = spark.createDataFrame([tuple(s[c] for c in columns) for s in rooted],
                               schema.of("shreds").add("root", "string"))
    return {r.provider: r for r in sets.anchored_set_stats(df, baseline).collect()}


def test_delays_are_signed_against_the_baseline(spark):
    got = live(spark, "p0", shred(0, rx=2000), shred(1, rx=1500))
    assert (got["p0"].fec_first_shred_delay_ns, got["p1"].fec_first_shred_delay_ns) == (0, -500)


def test_earliest_is_the_anchor_without_a_baseline(spark):
    got = live(spark, "p9", shred(0, rx=2000), shred(1, rx=1500))
    assert (got["p0"].fec_first_shred_delay_ns, got["p1"].fec_first_shred_delay_ns) == (500, 0)


def test_size_known_late_delays_decode(spark):
    # p0 holds enough at 1001, but k is known to anyone only at 3000, through p1.
    got = live(spark, None, shred(0, pos=0, rx=1000), shred(0, pos=1, rx=1001), shred(0, pos=2, rx=4000),
               coding(1, rx=3000, k=2))
    assert got["p0"].fec_decode_delay_ns == 0 and got["p0"].is_valid
    assert got["p1"].fec_decode_delay_ns is None and not got["p1"].is_valid


def test_set_without_a_sound_packet_gives_no_rows(spark):
    assert live(spark, None, shred(0, merkle=False), shred(1, merkle=False)) == {}


def test_structural_needs_the_first_root_and_version(spark):
    base = [dict(shred(p, rx=rx), root=root, version=v) for p, rx, root, v in
            [(0, 10, "other", 2), (1, 20, "r", 1), (2, 30, "x", 1), (3, 40, "r", 1), (4, 50, None, 1)]]
    columns = [*schema.columns("shreds"), "root", "version"]
    df = spark.createDataFrame([tuple(s[c] for c in columns) for s in base],
                               schema.of("shreds").add("root", "string").add("version", "long"))
    got = {r.provider: r.structural for r in sets.structural_valid(df, 1).collect()}
    assert got == {"p0": False, "p1": True, "p2": False, "p3": True, "p4": False}


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("p", -10), ("p", 0), ("p", 7), ("p", 10**9), ("p", None)],
                               "provider string, fec_first_shred_delay_ns long")
    got = {r.le: r.n for r in sets.delay_histogram(df, edges=(-5, 0, 5)).collect()}
    assert got == {"-5": 1, "0": 2, "5": 2, "+Inf": 4}


def test_newest_slots_are_kept(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "slot")
    assert sets.keep_newest_slots(df, 10).agg(F.min("slot"), F.count("*")).first()[:] == (89, 11)
