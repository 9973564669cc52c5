"""Dimensions, text columns, readers and writers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from firstpast import schema
from firstpast.functions import numeric, text
from firstpast.operators import dims
from firstpast.sources import readers, writers


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("url, host", [
    ("http://64.130.40.37:10000", "64.130.40.37"), ("10.0.0.5", "10.0.0.5"),
    ("https://1.2.3.4:443/foo", "1.2.3.4"), ("https://host.example?x=1:2", "host.example"),
    ("http://:80", ":80"), ("", None)])
def test_host(spark, url, host):
    assert one(spark, url, text.host_of) == host


@pytest.mark.parametrize("output, rtt", [
    ("3 packets\nrtt min/avg/max/mdev = 0.045/1.234/2.5/0.1 ms", 1.234),
    ("round-trip min/avg/max = 10.1/20.2/30.3 ms", 20.2), ("100% packet loss", None),
    ("rtt min/avg/max/mdev = 1/x/2/3 ms", None)])
def test_average_rtt(spark, output, rtt):
    assert one(spark, output, text.avg_rtt) == rtt


def test_probe_rtt(spark):
    assert one(spark, "64 bytes: icmp_seq=1 time=12.5 ms", text.probe_rtt) == 12.5
    assert one(spark, "lost", text.probe_rtt) is None


@pytest.mark.parametrize("source, brand", [
    ("Everstake-1", "everstake"), ("assymetric", "asymmetric"), ("p2p-ny", "p2p.org"), ("xp2p", "other")])
def test_brand(spark, source, brand):
    assert one(spark, source, text.brand_of) == brand


@pytest.mark.parametrize("source, ip", [
    ("fra-1.2.3.4", "1.2.3.4"), ("ny-1.2.3", None), ("lon-1.2.3.4", None), ("fra", None), ("ny-a-1.2.3.4", "a-1.2.3.4")])
def test_ip_in_name(spark, source, ip):
    assert one(spark, source, text.ip_in_name) == ip


@pytest.mark.parametrize("written, number", [("12.9", 12), ("-12.9", -12), ("1e3", 1000), ("x", None), (None, None)])
def test_lenient_int(spark, written, number):
    assert one(spark, written, numeric.lenient_int) == number


def test_small_functions(spark):
    assert one(spark, "[::1]:8001", text.strip_port) == "[::1]"
    assert one(spark, 1234567, text.grouped_int, "bigint") == "1,234,567"
    assert one(spark, "x" * 40, text.sheet_name) == "x" * 31
    assert one(spark, 5, lambda c: numeric.wrapping_u32_diff(c, F.lit(2**32 - 3)), "bigint") == 8
    assert one(spark, 3, lambda c: numeric.saturating_sub(c, F.lit(5).cast("bigint")), "bigint") == 0
    assert one(spark, 2, lambda c: numeric.unix_ns(c, F.lit(7)), "bigint") == 2_000_000_007
    assert one(spark, None, numeric.ms, "bigint") is None
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, when, text.utc_iso, "timestamp") == "2024-01-02T03:04:05Z"
    assert one(spark, when, text.utc_compact, "timestamp") == "20240102T030405Z"
    assert one(spark, "", lambda c: text.location_of(c, F.lit("DE"))) == "DE"
    assert one(spark, "a", lambda c: text.label(c, {"a": "A (a)"})) == "A (a)"


def test_rule_priority(spark):
    rules = spark.createDataFrame([("both", "a", 1, 0), ("port", None, 1, 1), ("ip", "a", None, 2)],
                                  "name string, ip string, port int, rule_order int")
    traffic = spark.createDataFrame([("a", 1), ("other", 1), ("a", 2), ("other", 2)], "src_ip string, dst_port int")
    got = {(r.src_ip, r.dst_port): r.provider for r in dims.resolve_provider(traffic, rules).collect()}
    assert got == {("a", 1): "both", ("other", 1): "port", ("a", 2): "ip", ("other", 2): None}


def test_rules_are_checked(spark):
    providers = spark.createDataFrame([("a", 9999, []), ("b", None, []), ("c", 1, []), ("c", None, ["x"])],
                                      "name string, port int, ips array<string>")
    ports = spark.createDataFrame([(1,), (2,)], "port int")
    feeds = spark.createDataFrame([("f", "u", "Confirmed"), ("g", " ", "someday")], "name string, url string, commitment string")
    got = {(r.rule, r.subject) for r in dims.rule_violations(providers, ports, feeds).collect()}
    assert got == {("port not listened on", "a"), ("neither port nor ips", "b"), ("duplicate name", "c"),
                   ("empty url", "g"), ("invalid commitment", "g")}


def test_slot_classes(spark):
    schedule = spark.createDataFrame([(1_000_000, "L")], "slot long, leader string")
    slots = spark.createDataFrame([(s,) for s in (567_999, 568_000, 1_000_000, 1_000_001, 1_863_999, 1_864_000)], "slot long")
    got = [r.slot_verdict for r in dims.classify_slot(slots, schedule, 1_000_000, 10).orderBy("slot").collect()]
    assert got == ["implausible", "unknown", "leader", "unknown", "unknown", "implausible"]


def test_schedule_must_be_complete(spark):
    responses = spark.createDataFrame([(100, 4, {"a": [0, 3], "b": [1, 2]}), (200, 3, {"a": [0, 9]})],
                                      schema.of("schedule_response"))
    flat = sorted((r.slot, r.leader) for r in dims.explode_schedule(responses.filter("first_slot = 100")).collect())
    assert flat == [(100, "a"), (101, "b"), (102, "b"), (103, "a")]
    got = {r.first_slot: (r.placed, r.complete) for r in dims.check_schedule(responses).collect()}
    assert got == {100: (4, True), 200: (1, False)}


def test_coverage_notes(spark):
    interest = spark.createDataFrame([("g", i) for i in ("1", "2", "3")], "group string, ip string")
    providers = spark.createDataFrame([("1", "n1", "t"), ("1", "n0", "t"), ("2", "n2", "u")], "src_ip string, name string, tier string")
    sources = spark.createDataFrame([("n1",)], "source string")
    firsts = spark.createDataFrame([("9",)], "src_ip string")
    got = {r.ip: r for r in dims.coverage(interest, providers, sources, firsts).collect()}
    assert (got["1"].registered_as, got["1"].arrivals_data, got["1"].note) == ("n0;n1", "yes", "")
    assert got["2"].note == "registered but no samples in window"
    assert got["3"].registered_as == "-" and got["3"].note.startswith("not registered")


def test_ping_rows(spark):
    configured = spark.createDataFrame([("p", "1.1.1.1")], "provider string, ip string")
    observed = spark.createDataFrame([("p", "1.1.1.1"), ("p", "1.1.1.2"), ("p", "1.1.1.2")], "provider string, ip string")
    samples = spark.createDataFrame([("1.1.1.1", 1, 5.0), ("1.1.1.1", 2, None)], "ip string, checked_at_ns long, rtt_ms double")
    feeds = spark.createDataFrame([("f", "https://1.1.1.3:1/x")], "name string, url string")
    rows = dims.provider_pings(dims.provider_ips(configured, observed), samples, feeds).orderBy(dims.ip_order()).collect()
    assert [r[:] for r in rows] == [("p", "1.1.1.1", "configured", None, 2), ("p", "1.1.1.2", "observed", None, None),
                                    ("f", "1.1.1.3", "grpc", None, None)]


def test_newest_row_wins(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "id long, name string, updated_at long")
    assert {r[:] for r in dims.upsert_latest(df, ["id"], "updated_at").collect()} == {(1, "new", 2), (2, "x", 1)}


# -- files ---------------------------------------------------------------------

KEY = "Certusm1sa411sMpV9FPqU5dXAYhmmhygvxJ23S6hJ24"


def test_report_csv_quotes_and_filters(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text(f'rank,leader,stake,name\n1,{KEY},5,"Acme, ""Inc"""\n2,{KEY[:-1]}x,5,  \n3,not a key!,5,Bad\n')
    assert [r[:] for r in readers.read_validator_report(spark, str(path)).collect()] == [(KEY, 'Acme, "Inc"')]


def test_report_attributes(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text(f"leader,name,client,version,data_center_key,active_stake\n{KEY},,c,v,d,12.7\n{KEY},N,,v2,d,oops\n,x,,,,\n")
    row = readers.read_validator_attributes(spark, str(path)).collect()
    assert [r[:] for r in row] == [(KEY, "N", None, "v2", "d", None)]


def test_name_ip_map_keeps_the_first(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_text("a|1.1.1.1\n\nb|2.2.2.2\na|3.3.3.3\n")
    assert {r[:] for r in readers.read_name_ip(spark, str(path)).collect()} == {("a", "1.1.1.1"), ("b", "2.2.2.2")}


def test_schedule_and_gossip_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"first_slot": 10, "slots_in_epoch": 2, "leaders": {"a": [0], "b": [1]}}')
    (tmp_path / "g.json").write_text('{"pubkey": "a", "gossip": "1.2.3.4:8001"}\n{"pubkey": "b", "gossip": null}\n')
    schedule = dims.explode_schedule(readers.read_schedule_json(spark, str(tmp_path / "s.json")))
    assert sorted(r[:] for r in schedule.collect()) == [(10, "a"), (11, "b")]
    assert [r[:] for r in readers.read_gossip_json(spark, str(tmp_path / "g.json")).collect()] == [("a", "1.2.3.4")]


def test_hour_predicates_cover_the_window():
    hours = readers.hour_predicates(dt.datetime(2024, 1, 1, 2), 2)
    assert len(hours) == 2 and hours[0].startswith("t >= '2024-01-01T00:00:00' AND t < '2024-01-01T01:00:00'")


def test_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "arrivals")
    rows = [(dt.datetime(2024, 1, d), "h", 1, 0, "s", d, None) for d in (1, 2, 3)]
    (spark.createDataFrame(rows, schema.of("arrivals")).withColumn("day", F.to_date("t"))
     .write.partitionBy("day").parquet(path))
    scan = readers.scan_arrivals(spark.read.parquet(path), dt.datetime(2024, 1, 3, 12), 24).select("source", "delta_ns")
    assert [r.delta_ns for r in scan.collect()] == [3]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThan(t" in plan and "IsNotNull(delta_ns)" in plan


def test_epoch_replacement_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "schedule")
    old = spark.createDataFrame([(5, "a"), (15, "a")], "slot long, leader string")
    writers.replace_epoch(old, path, 10)
    writers.replace_epoch(spark.createDataFrame([(6, "b")], "slot long, leader string"), path, 10)
    assert sorted((r.slot, r.leader) for r in spark.read.parquet(path).collect()) == [(6, "b"), (15, "a")]


def test_per_brand_files_hold_only_shareable_columns(spark, tmp_path):
    columns = ", ".join(f"{c} double" for c in writers.REPORTS["per_source"][2:])
    per_source = spark.createDataFrame([("h", s, *[1.23456] * 12) for s in ("everstake-1", "jito-fra", "nobody")],
                                       f"hub string, source string, {columns}")
    own = spark.createDataFrame([("h", "everstake-1", "own", 1, 50.0, 0.5)],
                                "hub string, source string, slots_kind string, samples long, "
                                "win_rate_of_samples_pct double, avg_delta_ms double")
    writers.write_per_brand(per_source, own, str(tmp_path / "out"))
    table = spark.read.option("header", True).csv(str(tmp_path / "out" / "overall"))
    assert [r.brand for r in table.collect()] == ["everstake"]
    assert "avg_rank" not in table.columns and table.first().win_rate_pct == "1.23"


def test_set_sinks_keep_their_schemas(spark, tmp_path):
    row = ("p", 1, 0, None, 5, 6, 7, 1, 1, 2, 0, 0, 0, 0, 0, 0, 0, True, False)
    path = str(tmp_path / "sets")
    writers.write_sets(spark.createDataFrame([row], schema.of("fec_sets")), path)
    back = spark.read.parquet(path)
    assert back.schema == schema.of("fec_sets") and back.first()[:] == row
    assert list((tmp_path / "sets").glob("*.zstd.parquet"))
