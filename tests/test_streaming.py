"""Streams: when a slot closes, what is late, timeouts, and equality with batch."""

import time
from glob import glob

import pytest
from pyspark.sql import functions as F
from test_sets import shred

from firstpast import schema
from firstpast.operators import sets, txns
from firstpast.plans import catalog
from firstpast.streaming import closing, eager, idle, sinks, slots, timeouts, waiting


class Feed:
    """A landing directory fed one batch at a time, and a query resumed after each."""

    def __init__(self, spark, tmp_path, table_schema, run):
        self.spark, self.schema, self.run = spark, table_schema, run
        self.path, self.out, self.state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def send(self, rows):
        names = self.schema.names
        self.spark.createDataFrame([tuple(r[c] for c in names) if isinstance(r, dict) else r for r in rows],
                                   self.schema).coalesce(1).write.mode("append").parquet(self.path)
        query = self.run(sinks.read_landed(self.spark, self.path, self.schema), self.out, self.state)
        query.awaitTermination()
        return query

    def rows(self):
        return self.spark.read.parquet(self.out)


@pytest.fixture
def sets_feed(spark, tmp_path):
    return Feed(spark, tmp_path, schema.of("shreds"), closing.set_rows_stream)


def drained(feed):
    closing.drain_set_rows(feed.spark, feed.schema, feed.out, feed.state)
    return feed.rows()


def emitted(feed):
    if not glob(feed.out + "/batch=*"):
        return []
    return sorted(r.slot for r in feed.rows().collect())


def test_a_slot_closes_exactly_when_wait_slots_passed(sets_feed):
    sets_feed.send([shred(slot=100, complete=True), shred(slot=101, complete=True)])
    sets_feed.send([shred(slot=109)])
    assert emitted(sets_feed) == []
    sets_feed.send([shred(slot=110)])
    assert emitted(sets_feed) == [100]


def test_stragglers_are_counted_and_open_no_second_row(sets_feed):
    sets_feed.send([shred(slot=100, complete=True)])
    sets_feed.send([shred(slot=200)])
    assert emitted(sets_feed) == [100]
    sets_feed.send([shred(slot=100, pos=1, rx=5000)] * 3 + [shred(slot=190)])
    assert closing.late_packets(sets_feed.spark, f"{sets_feed.state}-store") == 4  # every copy, and the cutoff itself
    sets_feed.send([shred(slot=300)])
    assert emitted(sets_feed) == [100, 200]


def test_truth_from_another_batch_classifies_the_failure(sets_feed):
    sets_feed.send([shred(1, pos=3, rx=1100, ok=False)])
    sets_feed.send([shred(0, pos=3, rx=1200)])
    sets_feed.send([shred(slot=120)])
    row = sets_feed.rows().filter("provider = 'p1'").first()
    assert (row.invalid, row.invalid_sig, row.invalid_unknown) == (1, 1, 0)


def test_packets_that_fail_their_checks_close_nothing(sets_feed):
    sets_feed.send([shred(slot=1), shred(slot=999_999, ok=False), shred(slot=2**41)])
    for slot in (2, 100, 200):
        sets_feed.send([shred(slot=slot)])
    assert emitted(sets_feed) == [1, 2, 100]
    assert closing.late_packets(sets_feed.spark, f"{sets_feed.state}-store") == 0
    assert sorted(r.slot for r in drained(sets_feed).collect()) == [1, 2, 100, 200, 999_999]


def test_drain_closes_what_is_open(sets_feed):
    sets_feed.send([shred(slot=100, complete=True), shred(slot=105)])
    assert emitted(sets_feed) == []
    assert sorted(r.slot for r in drained(sets_feed).collect()) == [100, 105]


def test_buckets_read_do_not_grow_with_the_run(spark, tmp_path, monkeypatch):
    """Each batch reads the buckets it closes, however many batches there were."""
    monkeypatch.setattr(closing, "WIDTH", 16)
    path, read = str(tmp_path / "packets"), []
    for batch in range(6):
        packets = spark.createDataFrame([(s,) for s in range(batch * 32, batch * 32 + 32)], "slot long").coalesce(1)
        closing.land(packets, path, batch)
        ends = (batch, batch * 32 - 11, batch * 32 + 21)
        assert closing.landed(spark, path, packets.schema, *ends).count() == min(32, batch * 32 + 22)
        read.append(closing.buckets(spark, path, packets.schema, *ends).select(F.input_file_name()).distinct().count())
    assert max(read) <= 4


def folders(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_dir())


def test_a_batch_costs_the_same_after_fifty_others(spark, tmp_path, monkeypatch):
    """Folders named, read and left do not grow with the run, though some packets of every batch name forged slots."""
    store, out = tmp_path / "store", str(tmp_path / "out")
    read, left, seen_paths = [], [], []
    reader = waiting.read
    monkeypatch.setattr(waiting, "read", lambda s, p, schema, parts: (seen_paths.append(list(parts)), reader(s, p, schema, parts))[1])
    process = closing.closing(str(store), out, lambda df: df.select("slot", "id"), F.col("good"))
    for batch in range(50):
        rows = spark.range(batch * 4, batch * 4 + 4, 1, 1).selectExpr("id AS slot", "id", "true AS good")
        if batch < 3:
            rows = rows.union(spark.range(1).selectExpr(f"{2**39 - batch}L", "-id", "false")).coalesce(1)
        process(rows, batch)
        read.append(len(seen_paths[-1]) if seen_paths else 0)
        left.append(len(folders(store)))
    # Slots wait for ten others, so three or four batches of four slots are open at a time.
    assert max(read) <= 4 and max(left[10:]) <= max(left[5:10]) and left[-1] <= 20
    closing.drain(spark, spark.createDataFrame([], "slot long, id long, good boolean").schema, str(store), out, lambda df: df.select("slot", "id"))
    got = [r.slot for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [*range(200), *sorted(2**39 - b for b in range(3))]


def test_a_replayed_batch_finds_what_it_had(spark, tmp_path):
    """A batch that died after its state was written is done again from the same folders, with the same rows."""
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    process = closing.closing(store, out, lambda df: df.select("slot"), F.lit(True))
    batches = [spark.createDataFrame([(s,) for s in slots_], "slot long").coalesce(1)
               for slots_ in ([1, 2, 3], [8, 12], [5, 30], [31, 60])]
    for k, batch in enumerate(batches):
        process(batch, k)
        once = sorted(r.slot for r in spark.read.parquet(out).filter(f"batch <= {k}").collect()) if k else []
        process(batch, k)
        if k:
            assert sorted(r.slot for r in spark.read.parquet(out).collect()) == once
    assert once == [1, 2, 3, 5, 8, 12, 30, 31]


def test_only_open_slots_are_written_to_wait(spark, tmp_path):
    store = str(tmp_path / "store")
    process = closing.closing(store, str(tmp_path / "out"), lambda df: df, F.lit(True))
    process(spark.range(1000).withColumnRenamed("id", "slot"), 0)
    state = waiting.last_state(spark, store)
    assert state.open == (waiting.Part(0, "near", 990, 999),) and state.tip == 999
    assert waiting.read(spark, store, spark.createDataFrame([], "slot long").schema, state.open).count() == 10


def test_a_forged_slot_adds_its_own_bucket_only(spark, tmp_path, monkeypatch):
    """Eager ranges read the buckets of the batch's slots, not all between the lowest and the highest."""
    asked = []
    finder = closing.of_buckets
    monkeypatch.setattr(eager, "of_buckets", lambda s, p, schema, b, wanted: (asked.append(sorted(wanted)), finder(s, p, schema, b, wanted))[1])
    emit = eager.eager_ranges(str(tmp_path / "store"), str(tmp_path / "out"))
    fields = "provider string, slot long, shred_index long, rx_ns long, data_complete boolean"
    emit(spark.createDataFrame([("p", 1, 0, 5, True), ("p", 90_000, 0, 5, True), ("p", 2**45, 0, 5, True)], fields), 0)
    assert asked[0] == [0, 90_000 // closing.WIDTH]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_guard_uses_the_schedule(spark):
    df = spark.createDataFrame([(s,) for s in (-1, 567_999, 568_000, 1_863_999, 1_864_000)], "slot long")
    assert [r.slot for r in slots.guard_slots(df, 1_000_000, 10).collect()] == [568_000, 1_863_999]


def test_stream_equals_batch(spark, tmp_path):
    shreds = [shred(p, slot=s, fec=f, pos=i, rx=1000 * s + 10 * i + p, ok=(i + p) % 5 != 0, complete=i == 2)
              for s in range(100, 130, 3) for f in (0, 32) for p in range(3) for i in range(3)]
    feed = Feed(spark, tmp_path, schema.of("shreds"), closing.set_rows_stream)
    for part in (shreds[:40], shreds[40:100], shreds[100:]):
        feed.send(part)
    drained(feed)
    columns = schema.columns("fec_sets")
    batch = sets.set_rows(spark.createDataFrame([tuple(s[c] for c in schema.columns("shreds")) for s in shreds],
                                                schema.of("shreds")))
    assert sorted(map(str, feed.rows().select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))


def test_signatures_retire_strictly_behind_the_margin(spark, tmp_path):
    feed = Feed(spark, tmp_path, schema.of("txn_events"), closing.txn_race_stream)
    feed.send([("0", "s", 1000, 10), ("1", "s", 2000, 10)])
    feed.send([("0", "t", 9000, 74)])
    assert feed.rows().count() == 0
    feed.send([("0", "u", 9000, 79)])
    totals = {r.source: r for r in txns.totals_of(feed.rows()).collect()}
    assert (totals["0"].wins, totals["1"].wins, totals["0"].contested_signatures) == (1, 0, 1)


def test_a_signature_has_the_slot_that_some_source_first_names(spark, tmp_path):
    """Sources that do not know the slot say 0; those that differ are scored together; the rest waits for the drain."""
    feed = Feed(spark, tmp_path, schema.of("txn_events"), closing.txn_race_stream)
    feed.send([("0", "s", 1000, 0), ("1", "s", 2000, 10), ("0", "z", 500, 0)])
    feed.send([("2", "s", 3000, 70), ("1", "z", 400, 0), ("0", "t", 9000, 80)])
    feed.send([("0", "y", 9500, 81)])
    assert {(r.signature, r.contestants) for r in feed.rows().collect()} == {("s", 3)}
    closing.drain_txn_race(spark, feed.out, feed.state)
    assert {(r.signature, r.contestants) for r in feed.rows().collect()} == {("s", 3), ("z", 2), ("t", 1), ("y", 1)}
    assert feed.rows().count() == 3 + 2 + 1 + 1


def test_parts_of_registered_streams_share_keys(spark, sf_dir):
    """No part is empty, and something of one slot, race or key comes in two parts."""
    from firstpast.plans.views import spark_view

    for view, key, spread in (("shreds", ["slot", "fec_set_index"], 9), ("txn_events", ["signature"], 63),
                              ("range_shreds", ["provider", "slot"], 50), ("txn_events", ["source"], 0)):
        parts = catalog.in_parts(spark_view(spark, sf_dir, view), spread)
        keys = [{tuple(r) for r in p.select(*key).distinct().collect()} for p in parts]
        assert len(keys) == 3 and all(keys)
        assert keys[0] & keys[1] or keys[1] & keys[2], (view, key)


def test_only_rows_near_a_border_are_dealt_by_their_hash(spark):
    """Away from the borders the hash of a row, which fails there, is not asked for; near them it deals as it says."""
    spread, slots = 9, 3000
    near = (F.col("slot") % 1000 > 989) & (F.col("slot") < 2000)
    said = F.lit(1.0) / near.cast("double") + F.col("slot")
    rows = spark.range(slots).select(F.col("id").alias("slot")).withColumn("said", said)
    dealt = [{r.slot for r in p.select("slot").collect()} for p in catalog.in_parts(rows, spread, "said")]
    assert sorted(s for part in dealt for s in part) == list(range(slots))
    late = {r.slot: r.late for r in rows.filter(near).select("slot", F.pmod(F.xxhash64("said"), F.lit(spread + 1)).alias("late")).collect()}
    assert all(s in dealt[(s + late.get(s, 0)) // 1000] for s in range(slots)) and len(late) > 10


def test_slots_settle_after_a_quiet_second(spark, tmp_path):
    def run(stream, out, state):
        return sinks.start(slots.settled_slots(stream).drop("session"), sinks.table_sink(out, "settled"), state)

    second = 1_000_000_000
    feed = Feed(spark, tmp_path, schema.of("shreds"), run)
    feed.send([shred(slot=1, rx=second), shred(slot=1, pos=1, rx=second + second // 2)])
    feed.send([shred(slot=9, rx=10 * second)])
    assert [(r.slot, r.packets, r.last_ns) for r in feed.rows().collect()] == [(1, 2, second + second // 2)]


def test_repeats_are_dropped_while_remembered(spark, tmp_path):
    def run(stream, out, state):
        return sinks.start(slots.first_sightings(stream, "k", "at"), sinks.table_sink(out, "seen"), state)

    feed = Feed(spark, tmp_path, spark.createDataFrame([], "k string, at timestamp").schema, run)
    base = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' t").first().t
    import datetime as dt
    feed.send([("a", base), ("a", base)])
    feed.send([("a", base + dt.timedelta(seconds=5)), ("b", base)])
    assert sorted(r.k for r in feed.rows().collect()) == ["a", "b"]


def test_ranges_are_emitted_once_when_they_fill(spark, tmp_path):
    store = str(tmp_path / "store")
    feed = Feed(spark, tmp_path, spark.createDataFrame(
        [], "provider string, slot long, shred_index long, rx_ns long, data_complete boolean").schema,
        lambda stream, out, state: sinks.start(stream, eager.eager_ranges(store, out), state))
    feed.send([("p", 1, 0, 10, False), ("p", 1, 2, 11, True)])
    assert feed.rows().count() == 0
    feed.send([("p", 1, 1, 30, False), ("p", 1, 3, 31, True)])
    feed.send([("p", 1, 1, 40, False), ("p", 1, 4, 41, True)])
    got = sorted((r.range_start, r.range_end, r.ready_ns, r.batch) for r in feed.rows().collect())
    assert got == [(0, 2, 30, 1), (3, 3, 31, 1), (4, 4, 41, 2)]


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    """Counts lie beside the table: a batch done again counts once, failed attempts count, a new sink goes on from there."""
    out, counts = str(tmp_path / "t"), str(tmp_path / "counts")
    write = sinks.table_sink(out, "t", counts)
    for _ in range(2):
        write(spark.range(3), 0)
    assert sinks.written_counts(spark, counts, "t") == (3, 0)
    broken = spark.range(2).withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    for _ in range(2):
        with pytest.raises(Exception):
            write(broken, 1)
    assert sinks.written_counts(spark, counts, "t") == (3, 2)
    again = sinks.table_sink(out, "t", counts)
    for batch in (1, 1, 2, 3, 4):
        again(spark.range(2), batch)
    assert spark.read.parquet(out).count() == 11 and sinks.written_counts(spark, counts, "t") == (11, 2)
    assert len(list((tmp_path / "counts" / "t").glob("[!._]*"))) <= 3


def test_a_batch_reads_its_own_epochs(spark, tmp_path, monkeypatch):
    from firstpast.sources import writers

    schedule, out, fetched = str(tmp_path / "schedule"), str(tmp_path / "out"), []
    whole = spark.range(0, 60).selectExpr("id AS slot", "concat('v', id) AS leader")
    writers.replace_epoch(whole.filter("slot < 20"), schedule, 10)

    def fetch(session, epoch):
        fetched.append(epoch)
        if epoch < 6:
            writers.replace_epoch(whole.filter(f"slot >= {epoch * 10} AND slot < {epoch * 10 + 10}"), schedule, 10)

    attach = eager.enriched(out, schedule, 10, fetch, F.col("good"))
    attach(spark.createDataFrame([(3, True), (25, True), (999, False)], "slot long, good boolean"), 0)
    attach(spark.createDataFrame([(26, True), (70, True)], "slot long, good boolean"), 1)
    got = {r.slot: r.leader for r in spark.read.parquet(out).collect()}
    # A forged epoch is not asked for, one that nobody knows leaves no leader.
    assert got == {3: "v3", 25: "v25", 26: "v26", 70: None, 999: None} and fetched == [2, 7]
    # Of the epochs 0 to 2, the second batch reads the last.
    read = []
    reader = type(spark.read)
    parquet = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **k: (read.extend(paths), parquet(self, *paths, **k))[1])
    attach(spark.createDataFrame([(27, True)], "slot long, good boolean"), 2)
    assert [p for p in read if "schedule" in p] == [f"{schedule}/epoch=2"]


def test_unknown_epochs_of_a_batch_are_asked_for_at_once(spark, tmp_path):
    from firstpast.sources import writers

    schedule, out, asked = str(tmp_path / "schedule"), str(tmp_path / "out"), []
    whole = spark.range(0, 60).selectExpr("id AS slot", "concat('v', id) AS leader")

    def fetch(session, epochs):
        asked.append(epochs)
        writers.replace_epoch(whole.filter(F.floor(F.col("slot") / 10).isin(epochs)), schedule, 10)

    attach = eager.enriched(out, schedule, 10, refresh_all=fetch)
    attach(spark.createDataFrame([(3,), (25,), (41,)], "slot long"), 0)
    attach(spark.createDataFrame([(4,), (33,), (99,)], "slot long"), 1)
    assert asked == [[0, 2, 4], [3, 9]]
    assert {r.slot: r.leader for r in spark.read.parquet(out).collect()} == {3: "v3", 25: "v25", 41: "v41", 4: "v4", 33: "v33", 99: None}


def test_an_epoch_is_one_file(spark, tmp_path):
    """However many tasks its rows come from; before, every task added a file to every epoch."""
    from firstpast.sources import writers

    rows = spark.range(0, 1000, 1, 8).selectExpr("id * 7919 % 1000 AS slot", "'v' AS leader")
    writers.replace_epoch(rows, str(tmp_path / "s"), 100)
    assert len(list((tmp_path / "s").glob("epoch=*/*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1000


def test_landed_files_follow_the_rows(spark, tmp_path):
    """8 tasks with packets of 100 buckets each leave a file per folder of buckets, and reading takes the asked buckets only."""
    rows = spark.range(0, 100 * closing.WIDTH, 1, 8).selectExpr("id * 7919 % 25600 AS slot")
    closing.land(rows, str(tmp_path / "in"), 0)
    assert len(list((tmp_path / "in").glob("**/*.parquet"))) <= 8
    got = closing.of_buckets(spark, str(tmp_path / "in"), rows.schema, 0, [3, 70])
    assert sorted({r.slot // closing.WIDTH for r in got.collect()}) == [3, 70] and got.count() == 2 * closing.WIDTH


def test_archives_have_as_many_files_as_their_rows_need(spark, tmp_path):
    """40 tasks, five windows of very different size: files follow the rows."""
    from firstpast.sources import writers

    rows = spark.range(0, 10_000, 1, 40).selectExpr(
        "id", "CASE WHEN id % 10 < 8 THEN 0 ELSE id % 5 END * 600000000000 + id AS first_ns", "'x' AS file_of_row")
    path = tmp_path / "archive"
    writers.write_rotated(rows, str(path), 600, file_rows=1000)
    files = list(path.glob("window_start=*/*.parquet"))
    assert len(files) <= 10_000 / 1000 + 5
    back = spark.read.parquet(str(path))
    assert back.count() == 10_000 and back.drop("window_start").columns == rows.columns


def test_sets_close_by_end_of_slot_timeout_or_age(spark, tmp_path):
    """Slot 500 ages the others out of reach; 100 ends its slot, 101 runs into the timeout."""
    path = str(tmp_path / "in")
    rows = [("p", 101, 0, False), ("p", 100, 0, True), ("p", 100, 0, True)]
    fields = "provider string, slot long, fec_set_index long, last_in_slot boolean"
    spark.createDataFrame(rows, fields).write.parquet(path)
    stream = sinks.read_landed(spark, path, spark.createDataFrame([], fields).schema)
    closed = timeouts.finalize_timeout(stream, grace_ms=1500)
    out, got = str(tmp_path / "out"), {}
    query = sinks.start(closed, sinks.table_sink(out, "closed"), str(tmp_path / "state"), every="500 milliseconds")
    try:
        deadline = time.time() + 90
        while time.time() < deadline and len(got) < 2 and query.isActive:
            time.sleep(1)
            if (tmp_path / "out").exists() and list((tmp_path / "out").glob("batch=*/*.parquet")):
                got = {r.slot: (r.reason, r.open_ms) for r in spark.read.parquet(out).collect()}
        spark.createDataFrame([("p", 500, 0, False), ("p", 490, 0, False)], fields).write.mode("append").parquet(path)
        while time.time() < deadline and 490 not in got and query.isActive:
            time.sleep(1)
            got = {r.slot: (r.reason, r.open_ms) for r in spark.read.parquet(out).collect()}
    finally:
        query.stop()
    assert got[100][0] == "complete" and got[101][0] == "timed out"
    assert got[100][1] >= 1500 and got[101][1] >= 6000
    assert got[490][0] == "aged" and got[490][1] < 6000
    assert spark.read.parquet(out).groupBy("slot").count().filter("count > 1").isEmpty()


def test_closed_sets_get_their_statistics(spark, tmp_path):
    rows = [shred(0, rx=2000), shred(1, rx=1500), shred(0, fec=32, rx=10)]
    columns = [*schema.columns("shreds"), "root"]
    rooted = schema.of("shreds").add("root", "string")
    packets = spark.createDataFrame([tuple({**r, "root": "r"}[c] for c in columns) for r in rows], rooted)
    closing.land(packets, str(tmp_path / "in"), 0)
    closed = spark.createDataFrame([(100, 0, "aged", 1)], "slot long, fec_set_index long, reason string, open_ms long")
    timeouts.set_stats_sink(str(tmp_path / "in"), rooted, str(tmp_path / "out"), "p0")(closed, 0)
    got = {(r.provider, r.fec_set_index): r.fec_first_shred_delay_ns for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("p0", 0): 0, ("p1", 0): -500}


def test_leaders_come_from_the_schedule(spark):
    stream_like = spark.createDataFrame([(1,), (2,)], "slot long")
    schedule = spark.createDataFrame([(1, "L")], "slot long, leader string")
    assert {r[:] for r in slots.enrich_static(stream_like, schedule).collect()} == {(1, "L"), (2, None)}


def test_rotated_sink(spark, tmp_path):
    rows = spark.createDataFrame([(s * 10**9,) for s in (0, 599, 600, 1300)], "first_ns long")
    sinks.rotated_sink(str(tmp_path / "r"), 600)(rows, 0)
    got = spark.read.parquet(str(tmp_path / "r")).groupBy("window_start").agg(F.count("*").alias("n")).collect()
    assert {(r.window_start, r.n) for r in got} == {(0, 2), (600, 1), (1200, 1)}


def test_a_silent_slot_is_forgotten_and_comes_back(spark, tmp_path):
    """Lives end by the packets' own time, over restarts; a late packet joins two lives that are still open."""
    second = 1_000_000_000

    def run(stream, out, state):
        return sinks.start(idle.idle_slots(stream, 20, 60), lambda df, b: sinks.put_batch(df, out, b), state)

    feed = Feed(spark, tmp_path, spark.createDataFrame([], "slot long, rx_ns long").schema, run)
    def send(*packets):
        feed.send([(slot, (1000 + at) * second) for slot, at in packets])

    def lives():
        return {(r.slot, r.first_ns // second - 1000, r.last_ns // second - 1000, r.packets) for r in feed.rows().collect()}

    send((1, 0), (1, 5), (2, 1))
    send((1, 40), (1, 45))      # silent for 35 s: another life
    send((1, 23), (2, 70))      # late, between the two lives of slot 1
    assert lives() == set()
    send((9, 500))
    assert lives() == {(1, 0, 45, 5), (2, 1, 1, 1), (2, 70, 70, 1)}
    send((1, 600))
    send((9, 900))
    assert (1, 600, 600, 1) in lives()


@pytest.mark.parametrize("seed", range(5))
def test_lives_do_not_depend_on_the_order_of_packets(seed):
    import random
    rng = random.Random(seed)
    times = [rng.randrange(400) for _ in range(60)]
    whole = idle.joined_lives([(t, t, 1) for t in times], 7)
    held = []
    for t in times:
        held = idle.joined_lives([*held, (t, t, 1)], 7)
    assert held == whole and sum(n for *_, n in whole) == 60
    assert all(b[0] - a[1] >= 7 for a, b in zip(whole, whole[1:]))


@pytest.mark.parametrize("seed", range(2))
def test_ended_lives_are_those_of_the_whole_table(spark, tmp_path, seed):
    """Batches in any order inside the delay, each done twice, give the lives of all packets, to the nanosecond."""
    import random
    rng = random.Random(seed)
    ttl, delay = 2_000_000_000, 5
    packets = sorted((rng.randrange(60_000_000_000), rng.randrange(4)) for _ in range(300))
    packets += [(70_000_000_000, 9), (72_000_000_000, 9), (73_999_999_999, 9), (500_000_000_000, 5)]
    packets.sort(key=lambda p: p[0] + rng.randrange(delay * 1_000_000_000))
    end = idle.ended_lives(str(tmp_path / "store"), str(tmp_path / "out"), ("slot",), 2, delay)
    for k in range(0, len(packets), 60):
        batch = spark.createDataFrame([(s, t) for t, s in packets[k:k + 60]], "slot long, rx_ns long").repartition(3)
        for _ in range(2):
            end(batch, k // 60)
    got = sorted(r[:4] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((slot, *life) for slot in range(10) for life in idle.joined_lives([(t, t, 1) for t, s in packets if s == slot], ttl))
    assert got == [w for w in want if w[0] != 5]
    assert len(list((tmp_path / "store" / "lives").iterdir())) <= 2
    # Too late: dropped and counted.
    end(spark.createDataFrame([(1, 3)], "slot long, rx_ns long"), -(-len(packets) // 60))
    assert waiting.read_note(spark, f"{tmp_path}/store/clock/batch={-(-len(packets) // 60)}")["late"] == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_the_memory_of_triggers_is_emptied_at_its_size(spark, tmp_path):
    out = str(tmp_path / "out")
    write = idle.seen_once(out, "k", 3)
    passed = []
    for batch, keys in enumerate((["a", "b", "a"], ["a", "c"], ["d", "b"], ["a", "d", None], ["e"])):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        write(df, batch)
        write(df, batch)  # done again after a crash: the same
        passed.append(sorted(r.k for r in spark.read.parquet(f"{out}/batch={batch}").collect()))
    assert passed == [["a", "b"], ["c"], ["d"], ["a", "d"], ["e"]]


def test_sets_close_by_their_packets_own_times(spark, tmp_path):
    """All three reasons, over restarts and a batch done again; a closed set opens no second row."""
    second = 1_000_000_000
    fields = "slot long, fec_set_index long, last_in_slot boolean, good boolean, rx_ns long"
    feed = Feed(spark, tmp_path, spark.createDataFrame([], fields).schema, lambda stream, out, state: sinks.start(
        stream, timeouts.closing_sets(str(tmp_path / "store"), out, F.col("good")), state))
    feed.send([(100, 0, True, True, 0), (100, 32, False, True, second), (101, 0, False, True, 2 * second)])
    assert feed.rows().count() == 0
    feed.send([(102, 0, None, True, 4 * second), (100, 0, False, True, 4 * second), (10**9, 0, False, False, 4 * second)])
    assert {r[:4] for r in feed.rows().collect()} == {(100, 0, "complete", 4000)}
    feed.send([(103, 0, False, True, 13 * second)])
    feed.send([(100, 0, True, True, 14 * second), (101, 0, False, True, 13 * second), (115, 0, False, True, 14 * second)])
    feed.send([(100, 64, False, True, 15 * second)])
    got = {r[:4] for r in feed.rows().collect()}
    assert got == {(100, 0, "complete", 4000), (100, 32, "timed out", 12000), (101, 0, "aged", 12000), (102, 0, "aged", 10000),
                   (103, 0, "aged", 1000)}
    replay = spark.createDataFrame([(100, 64, False, True, 15 * second)], fields)
    timeouts.closing_sets(str(tmp_path / "store"), feed.out, F.col("good"))(replay, 4)
    assert {r[:4] for r in feed.rows().collect()} == got
    assert len(list((tmp_path / "store" / "sets").iterdir())) <= 2
