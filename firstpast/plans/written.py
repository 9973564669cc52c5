"""Queries over what the writers and streams leave behind, over report order, and over text forms.

They join the other registered queries: ``QUERIES`` and ``CHECKS`` hold all of them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firstpast.functions import binary, numeric, text
from firstpast.operators import dims, packets, quality, sets, stats
from firstpast.plans import catalog, checks, reports
from firstpast.plans.catalog import QUERIES, query, table
from firstpast.plans.checks import CHECKS
from firstpast.plans.views import check_ctes, check_view, spark_view
from firstpast.session import materialize, working_path
from firstpast.sources import readers, writers
from firstpast.streaming import idle, sinks, slots, timeouts


# -- tables ----------------------------------------------------------------------

@query
def set_row_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set rows written to their table and read back with its fixed schema."""
    path = working_path(spark, "set-rows")
    writers.write_sets(catalog._set_rows(spark, sf_dir), path)
    return readers.read_table(spark, path, "fec_sets")


CHECKS["set_row_table"] = CHECKS["set_rows"]


@query
def packet_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with their slot's leader, written to the dump and read back."""
    path = working_path(spark, "dump")
    shreds = spark_view(spark, sf_dir, "shreds").join(spark_view(spark, sf_dir, "schedule"), "slot", "left")
    writers.write_shreds(shreds, path)
    return readers.read_table(spark, path, "shred_dump")


CHECKS["packet_dump"] = check_ctes("shreds", "schedule") + """
SELECT provider, slot, fec_set_index, shred_index, is_code, rx_ns AS rx_unix_ns, sig_ok, merkle_ok, leader, data_hash
FROM shreds LEFT JOIN schedule USING (slot)"""


@query
def brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-brand directories of the overall report, read back as text."""
    path = working_path(spark, "brands")
    sources = catalog._named_sources(spark, sf_dir).groupBy("hub", "source").agg(
        F.count("*").alias("samples"), F.count_if(F.col("hub") == "F").alias("f"))
    wide = sources.select("hub", "source", "samples", *[F.lit(1.2345678).alias(c) for c in writers.SHAREABLE["overall"][3:]])
    own = sources.select("hub", "source", F.lit("own").alias("slots_kind"), "samples", F.lit(7.125).alias("win_rate_of_samples_pct"),
                         F.lit(0.5).alias("avg_delta_ms"))
    writers.write_per_brand(wide, own, path)
    return spark.read.option("header", True).csv(f"{path}/overall").select(
        "brand", "hub", "source", F.col("samples").cast("bigint").alias("samples"), "win_rate_pct", "p50_ms", "avg_delta_ms")


CHECKS["brand_files"] = f"""
SELECT brand, hub, source, samples, '1.23' AS win_rate_pct, '1.235' AS p50_ms, '1.2346' AS avg_delta_ms
FROM ({checks.CHECKS["per_brand_panel"]}) b"""


@query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-source report with its rounded columns, and the place of every row in the file."""
    path = working_path(spark, "report")
    per_source = stats.per_source_stats(catalog._ranked(spark, sf_dir))
    writers.write_report_csv(reports.order_sources(per_source), path, "per_source")
    return placed(spark.read.option("header", True).csv(f"{path}/per_source")).select(
        "place", "hub", "source", *[F.col(c).cast("double").alias(c) for c in writers.REPORTS["per_source"][2:]])


CHECKS["report_files"] = f"""
SELECT row_number() OVER (ORDER BY hub, win_count DESC, source) - 1 AS place, hub, source, CAST(samples AS DOUBLE) AS samples,
       CAST(win_count AS DOUBLE) AS win_count, round(win_rate_pct, 2) AS win_rate_pct, round(avg_rank, 2) AS avg_rank,
       round(avg_delta_ms, 4) AS avg_delta_ms, round(p50_ms, 3) AS p50_ms, round(p90_ms, 3) AS p90_ms, round(p99_ms, 3) AS p99_ms,
       round(min_ms, 4) AS min_ms, round(max_ms, 4) AS max_ms, round(beats_baseline_pct, 2) AS beats_baseline_pct,
       round(coverage_pct, 2) AS coverage_pct
FROM ({checks.CHECKS["per_source_stats"]}) s"""


@query
def leader_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leader split in report order, with every source's address, network and location."""
    suppliers = table(spark, sf_dir, "supplier")
    name_ip = (suppliers.groupBy(catalog._named("src-", F.col("s_suppkey") % 8).alias("name"))
               .agg(F.min(catalog._ip()).alias("ip")))
    asn = (suppliers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .select(catalog._ip().alias("ip"), F.col("n_name").alias("org"), F.lit("").alias("city"),
                   F.col("n_regionkey").cast("string").alias("country")))
    split = stats.leader_split(catalog._slot_totals(spark, sf_dir))
    return placed(reports.leader_breakdown(split, name_ip, asn))


CHECKS["leader_breakdown"] = f"""
WITH ips AS (SELECT concat('src-', s_suppkey % 8) AS source, min(concat('10.0.', s_nationkey, '.', s_suppkey)) AS src_ip
             FROM supplier GROUP BY 1),
nets AS (SELECT concat('10.0.', s_nationkey, '.', s_suppkey) AS src_ip, n_name AS asn_dc, CAST(n_regionkey AS VARCHAR) AS dc_location
         FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT row_number() OVER (ORDER BY hub, leader_provider, win_rate_pct DESC, source) - 1 AS place, s.*, coalesce(src_ip, '') AS src_ip,
       coalesce(asn_dc, '') AS asn_dc, coalesce(dc_location, '') AS dc_location
FROM ({checks.CHECKS["leader_split"]}) s LEFT JOIN ips USING (source) LEFT JOIN nets USING (src_ip)"""


@query
def performance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every report file of the performance report, and what its meta file says."""
    path = working_path(spark, "performance")
    brands, schedule = spark_view(spark, sf_dir, "leader_brands"), spark_view(spark, sf_dir, "schedule")
    firsts, providers = spark_view(spark, sf_dir, "first_provider"), spark_view(spark, sf_dir, "providers")
    interest = providers.select(F.col("name").alias("group"), F.col("src_ip").alias("ip"))
    reports.performance_report(
        catalog._arrivals(spark, sf_dir), schedule, brands, path, catalog.BASELINES, source_brand=F.col("source"), firsts=firsts,
        providers=providers, interest=interest, window=(dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 2)), epochs=(7, 8))
    rows = [spark.read.option("header", True).csv(f"{path}/{name}").agg(F.count("*").alias("value"))
            .select(F.lit(name).alias("name"), "value")
            for name in ("per_source", "first_provider", "ip_coverage", "leader_slots", "signature_panel")]
    meta = spark.read.json(f"{path}/meta")
    for name, value in (("unknown_leader_slots", F.col("unknown_leader_slots")), ("hours", F.col("window_hours")),
                        ("epochs", F.size("epochs")), ("races_f", F.col("fec_sets_per_hub.F"))):
        rows.append(meta.select(F.lit(name).alias("name"), value.cast("bigint").alias("value")))
    found = rows[0]
    for more in rows[1:]:
        found = found.union(more)
    return found


def _counted(name: str, of: str) -> str:
    return f"SELECT '{name}' AS name, count(*) AS value FROM ({checks.CHECKS[of]}) q"


CHECKS["performance_files"] = " UNION ALL ".join([
    _counted("per_source", "per_source_stats"), _counted("first_provider", "first_provider_share"),
    "SELECT 'ip_coverage', count(*) FROM supplier", _counted("leader_slots", "leader_split"),
    _counted("signature_panel", "signature_panel"),
    f"SELECT 'unknown_leader_slots', unknown_leader_slots FROM ({checks.CHECKS['unknown_leader_slots']}) u",
    "SELECT 'hours', 24", "SELECT 'epochs', 2",
    f"SELECT 'races_f', races FROM ({checks.CHECKS['races_per_hub']}) r WHERE hub = 'F'"])


# -- order -------------------------------------------------------------------------

def placed(ordered: DataFrame) -> DataFrame:
    """The place of every row of a report; reports have a row per source or pair of sources."""
    return ordered.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query
def leader_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stats.leader_split(catalog._slot_totals(spark, sf_dir))
    return placed(reports.order_leaders(split)).select("place", "hub", "leader_provider", "source")


CHECKS["leader_order"] = f"""
SELECT row_number() OVER (ORDER BY hub, leader_provider, win_rate_pct DESC, source) - 1 AS place, hub, leader_provider, source
FROM ({checks.CHECKS["leader_split"]}) s"""


@query
def trend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = stats.daily_trend(catalog._arrivals(spark, sf_dir))
    return placed(reports.order_trend(trend)).select("place", "hub", "source", F.date_format("day", "yyyy-MM-dd").alias("day"))


CHECKS["trend_order"] = f"""
SELECT row_number() OVER (ORDER BY day, hub, avg_delta_ms, source) - 1 AS place, hub, source, day
FROM ({checks.CHECKS["daily_trend"]}) s"""


@query
def scoreboard_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = sets.contested_scoreboard(catalog._set_rows(spark, sf_dir))
    return placed(sets.order_scoreboard(board)).select("place", "provider")


CHECKS["scoreboard_order"] = f"""
SELECT row_number() OVER (ORDER BY winrate DESC NULLS LAST, coverage DESC, provider) - 1 AS place, provider
FROM ({checks.CHECKS["contested_scoreboard"]}) s"""


# -- text forms ----------------------------------------------------------------------

@query
def schedule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule responses of two epochs written as JSON, read back, and put into one schedule."""
    path = working_path(spark, "responses")
    responses = catalog._schedule_responses(table(spark, sf_dir, "orders"))
    responses.write.json(path)
    read = readers.read_schedule_json(spark, path)
    even = F.col("first_slot") % 2000 == 0
    return dims.union_epochs(dims.explode_schedule(read.filter(even)), dims.explode_schedule(read.filter(~even)))


CHECKS["schedule_files"] = CHECKS["schedule_explode"]


@query
def written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, names and times of the orders as reports write them."""
    cents = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.grouped_int(cents).alias("cents"),
        text.sheet_name(F.concat(F.lit("orders of the customer number "), F.col("o_custkey"))).alias("sheet"),
        text.utc_iso(F.col("o_orderdate").cast("timestamp")).alias("iso"),
        text.utc_compact(F.col("o_orderdate").cast("timestamp")).alias("compact"),
        numeric.unix_ns(F.col("o_orderkey"), F.col("o_custkey")).alias("ns"))


CHECKS["written_forms"] = """
SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice * 100) AS BIGINT)) AS cents,
       left(concat('orders of the customer number ', o_custkey), 31) AS sheet,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS compact,
       o_orderkey * 1000000000 + o_custkey AS ns
FROM orders"""


@query
def packet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content hash of every packet, data and code."""
    built = catalog.packets_of(spark_view(spark, sf_dir, "shreds")).select("provider", "rx_ns", "payload")
    return packets.parse_shreds(built).select("provider", "rx_ns", "slot", "shred_index", "data_hash")


def _reversed_hex(value: str, size: int) -> str:
    return f"array_to_string([substr(printf('%0{2 * size}x', {value}), 2 * i + 1, 2) for i in range({size - 1}, -1, -1)], '')"


def _content_bytes(whole: int) -> int:
    """Bytes of a packet's content behind its header: without root and six proof entries."""
    return whole - binary.ROOT_LEN - 6 * binary.PROOF_ENTRY_LEN - binary.HEADER_END


CHECKS["packet_hashes"] = check_ctes("shreds") + f"""
SELECT provider, rx_ns, slot, shred_index, sha256(unhex(concat(
  CASE WHEN is_code THEN '66' ELSE '96' END, {_reversed_hex('slot', 8)}, {_reversed_hex('shred_index', 4)},
  {_reversed_hex('version', 2)}, {_reversed_hex('fec_set_index', 4)},
  CASE WHEN is_code THEN concat({_reversed_hex('num_data', 2)}, {_reversed_hex('num_coding', 2)}, {_reversed_hex('position', 2)})
       ELSE concat('0000', CASE WHEN last_in_slot THEN 'C0' WHEN data_complete THEN '40' ELSE '00' END, '000000') END,
  substr(repeat(data_hash, 72), 1, 2 * CASE WHEN is_code THEN {_content_bytes(binary.CODE_PAYLOAD)}
                                            ELSE {_content_bytes(binary.DATA_PAYLOAD)} END)))) AS data_hash
FROM shreds"""


# -- streams -------------------------------------------------------------------------

@query
def stream_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an append sink wrote, rows that it says it wrote, and failed attempts; every part in a session of its own."""
    out, state, counts, landing = (working_path(spark, n) for n in ("appended", "state", "counts", "events"))
    parts = catalog.in_parts(spark_view(spark, sf_dir, "txn_events"), 5)
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(landing)
        session = spark.newSession()
        write = sinks.table_sink(out, "events", counts)
        # The second part cannot be written at first: one of its rows cannot be worked out.
        spoilt = lambda df, b: write(df.withColumn("ns", F.when(F.col("ns") >= 0, F.raise_error(F.lit("not now"))).otherwise(0)), b)
        for attempt in ([spoilt, write] if k == 1 else [write]):
            stream = sinks.start(sinks.read_landed(session, landing, parts[0].schema), attempt, state)
            try:
                stream.awaitTermination()
            except StreamingQueryException:
                if attempt is write:
                    raise
    rows, failed = sinks.written_counts(spark, counts, "events")
    return spark.read.parquet(out).agg(F.count("*").alias("found")).select(
        "found", F.lit(rows).cast("bigint").alias("counted"), F.lit(failed).cast("bigint").alias("failed"))


CHECKS["stream_appended"] = "SELECT count(*) AS found, count(*) AS counted, 1 AS failed FROM events"


@query
def stream_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets filed under tumbling windows by a stream (fixture times are scaled up)."""
    out, state = working_path(spark, "rotated"), working_path(spark, "state")
    rows = spark_view(spark, sf_dir, "shreds").select("provider", "slot", (F.col("rx_ns") * 10_000).alias("first_ns"))
    catalog._fed(catalog.in_parts(rows, 9), "packets", lambda s: sinks.start(s, sinks.rotated_sink(out, 600), state))
    return spark.read.parquet(out).groupBy(F.col("window_start").cast("bigint").alias("window_start")).agg(
        F.count("*").alias("packets"))


CHECKS["stream_rotated"] = check_ctes("shreds") + """
SELECT CAST(floor(rx_ns * 10000 / 600e9) * 600 AS BIGINT) AS window_start, count(*) AS packets FROM shreds GROUP BY 1"""


@query
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures that a stream saw first, remembered for as long as the events last."""
    out, state = working_path(spark, "sightings"), working_path(spark, "state")
    events = spark_view(spark, sf_dir, "txn_events").withColumn("at", F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("bigint")))
    parts = catalog.in_parts(events, 9)
    seen = lambda s: slots.first_sightings(s, "signature", "at", 3_000 * 86_400)
    catalog._fed(parts, "events", lambda s: sinks.start(seen(s), sinks.table_sink(out, "seen"), state))
    return spark.read.parquet(out).groupBy("signature").agg(F.count("*").alias("sightings"))


CHECKS["stream_first_sightings"] = f"""
SELECT signature, 1 AS sightings FROM ({check_view("txn_events")}) e GROUP BY signature"""


# A stand-in clock: fixture times scaled up, so that a day of the tables is a second of the stream.
_SCALE = 10_000


def _by_time(spark: SparkSession, sf_dir: str, late_secs: int) -> list[DataFrame]:
    """Packets as the parts of a stream in order of time, some late, and a last one that moves the clock past all ends."""
    packets = spark_view(spark, sf_dir, "shreds").select(
        "provider", F.col("slot").alias("of_slot"), (F.col("rx_ns") * _SCALE).alias("rx_ns"))
    timed = packets.withColumn("slot", F.floor(F.col("rx_ns") / F.lit(1e9)).cast("bigint"))
    parts = catalog.in_parts(timed, late_secs, "of_slot", "rx_ns")
    end = timed.agg(F.max("rx_ns")).first()[0] or 0
    last = spark.range(1).select(F.lit("clock").alias("provider"), F.lit(-1).cast("bigint").alias("of_slot"),
                                 F.lit(end + 10**12).cast("bigint").alias("rx_ns"), F.lit(-1).cast("bigint").alias("slot"))
    return [p.select("provider", F.col("of_slot").alias("slot"), "rx_ns") for p in [*parts, last]]


def _lives_check(by: str, gap_secs: int) -> str:
    return check_ctes("shreds") + f""",
t AS (SELECT {by}, rx_ns * {_SCALE} AS ns FROM shreds),
m AS (SELECT *, CASE WHEN ns - lag(ns) OVER (PARTITION BY {by} ORDER BY ns) < {gap_secs}000000000 THEN 0 ELSE 1 END AS begins FROM t),
l AS (SELECT *, sum(begins) OVER (PARTITION BY {by} ORDER BY ns ROWS UNBOUNDED PRECEDING) AS life FROM m)
SELECT {by}, min(ns) AS first_ns, max(ns) AS last_ns, count(*) AS packets FROM l GROUP BY {by}, life"""


@query
def stream_settled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a provider that had no packet for half a minute; most such quiet periods end in another batch."""
    out, state, store = (working_path(spark, n) for n in ("settled", "state", "lives"))
    settle = idle.ended_lives(store, out, ("provider", "slot"), 30, 30)
    catalog._fed(_by_time(spark, sf_dir, 25), "packets", lambda s: sinks.start(s, settle, state))
    return spark.read.parquet(out).filter("provider <> 'clock'").select("provider", "slot", "packets", "first_ns", "last_ns")


CHECKS["stream_settled_slots"] = _lives_check("provider, slot", 30)


@query
def stream_idle_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives of slots whose state is dropped after 20 silent seconds; slots come back many times."""
    out, state, store = (working_path(spark, n) for n in ("idle", "state", "lives"))
    end = idle.ended_lives(store, out, ("slot",), idle.SLOT_TTL_SECS, 30)
    catalog._fed(_by_time(spark, sf_dir, 25), "packets", lambda s: sinks.start(s, end, state))
    return spark.read.parquet(out).filter("slot >= 0").drop("batch")


CHECKS["stream_idle_slots"] = _lives_check("slot", idle.SLOT_TTL_SECS)


@query
def stream_seen_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a signature passes a memory that is emptied once it holds more than half of those in the first part."""
    out, state = working_path(spark, "triggers"), working_path(spark, "state")
    parts = catalog.in_parts(spark_view(spark, sf_dir, "txn_events").withColumn("trigger", F.col("source")), 0)
    catalog._fed(parts, "events", lambda s: sinks.start(s, idle.seen_once(out, "trigger", 3), state))
    return spark.read.parquet(out).groupBy("trigger").agg(F.count("*").alias("passed"))


# Five event types pass in the first part; more than three are too many to remember, so each passes in every part.
CHECKS["stream_seen_triggers"] = check_ctes("txn_events") + """,
b AS (SELECT min(slot) AS low, max(slot) AS high FROM txn_events),
p AS (SELECT DISTINCT source AS trigger, least(greatest(CAST(floor((slot - low) * 3 / CAST(high - low + 1 AS DOUBLE)) AS BIGINT), 0), 2) AS part
      FROM txn_events CROSS JOIN b),
a AS (SELECT trigger, part FROM p WHERE part = 0),
k0 AS (SELECT trigger FROM a WHERE (SELECT count(*) FROM a) <= 3),
c AS (SELECT trigger FROM p WHERE part = 1 AND trigger NOT IN (SELECT trigger FROM k0)),
u AS (SELECT trigger FROM k0 UNION ALL SELECT trigger FROM c),
k1 AS (SELECT trigger FROM u WHERE (SELECT count(*) FROM u) <= 3),
d AS (SELECT trigger FROM p WHERE part = 2 AND trigger NOT IN (SELECT trigger FROM k1))
SELECT trigger, count(*) AS passed FROM (SELECT trigger FROM a UNION ALL SELECT trigger FROM c UNION ALL SELECT trigger FROM d) x
GROUP BY trigger"""


# Slots that a set may stay behind the tip in the timeout query, and its clock: a second a slot, and up to 20 s of delay.
_BEHIND = 300
_CLOCK = "slot * 1000000000 + (rx_ns * 7919 * 10000) % 20000000000"


@query
def stream_timeout_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets closed by age, by the end of their slot or by timeout; every fiftieth packet comes with the last part."""
    out, state, store = (working_path(spark, n) for n in ("closed-sets", "state", "sets"))
    shreds = spark_view(spark, sf_dir, "shreds").selectExpr(
        "slot", "fec_set_index", "last_in_slot", "merkle_ok", "sig_ok", "rx_ns % 50 = 0 AS held", f"{_CLOCK} AS rx_ns")
    low, high = shreds.agg(F.min("slot"), F.max("slot")).first()
    part = F.when(F.col("held"), 2).otherwise(catalog.part_of(F.col("slot"), low, high))
    close = timeouts.closing_sets(store, out, sets.acceptance() == "ok", wait_slots=_BEHIND)
    catalog._fed([shreds.filter(part == k) for k in range(3)], "packets", lambda s: sinks.start(s, close, state))
    return spark.read.parquet(out).drop("batch")


CHECKS["stream_timeout_sets"] = check_ctes("shreds") + f""",
e AS (SELECT min(slot) AS low, max(slot) AS high FROM shreds),
p AS (SELECT slot, fec_set_index, coalesce(last_in_slot, false) AS ended, merkle_ok AND sig_ok AS accepted, {_CLOCK} AS ns,
             CASE WHEN rx_ns % 50 = 0 THEN 2 ELSE
               least(greatest(CAST(floor((slot - low) * 3 / CAST(high - low + 1 AS DOUBLE)) AS BIGINT), 0), 2) END AS part
      FROM shreds CROSS JOIN e),
tips AS (SELECT b, (SELECT max(slot) FROM p WHERE part <= b AND accepted) AS tip,
                (SELECT max(slot) FROM p WHERE part < b AND accepted) AS earlier FROM (VALUES (0), (1), (2)) AS n(b)),
live AS (SELECT p.* FROM p JOIN tips ON part = b WHERE earlier IS NULL OR slot > earlier - {_BEHIND}),
clock AS (SELECT b, tip, (SELECT max(ns) FROM live WHERE part <= b) AS now FROM tips),
m AS (SELECT slot, fec_set_index, b, min(ns) AS first, bool_or(ended) AS ended FROM live JOIN clock ON part <= b GROUP BY ALL),
r AS (SELECT slot, fec_set_index, b, now - first AS open,
             CASE WHEN slot <= tip - {_BEHIND} THEN 'aged' WHEN ended AND now - first >= 3000000000 THEN 'complete'
                  WHEN now - first >= 12000000000 THEN 'timed out' END AS reason FROM m JOIN clock USING (b)),
f AS (SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index ORDER BY b) AS nth FROM r WHERE reason IS NOT NULL)
SELECT slot, fec_set_index, reason, CAST(floor(open / 1e6) AS BIGINT) AS open_ms FROM f WHERE nth = 1"""


# -- the whole description of a run ------------------------------------------------------

# What a capture would say of itself, taken from the events: packets received, without a time, lost on intake, too long.
_CAPTURE = {"udp_received": 1, "udp_no_timestamp": 97, "udp_channel_full": 89, "udp_truncated": 83}
_ALL_COUNTERS = (*quality.OF_VERDICT, *quality.CAPTURED, "udp_unmatched", "udp_kernel_dropped", "shreds_after_window",
                 "invalid_sig", "invalid_data", "invalid_unknown")


@query
def full_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run with all its counters, the notes they give rise to, pings, leader names and transactions."""
    def of(name: str) -> DataFrame:
        return QUERIES[name](spark, sf_dir)

    rows = materialize(catalog._set_rows(spark, sf_dir), "set-rows")
    capture = table(spark, sf_dir, "events").agg(*[F.count_if(F.col("event_id") % k == 0).alias(c) for c, k in _CAPTURE.items()])
    counters = materialize(quality.run_counters(capture, of("packet_verdicts"), of("rule_match"), of("socket_losses"),
                                                of("stream_late_packets"), quality.split_totals(rows)), "counters")
    doc = quality.manifest(quality.archive_extent(rows), counters, quality.quality_notes(counters), of("txn_race"),
                           of("provider_pings"), of("leader_names"), clock="unix nanoseconds")

    def number(path: str, name: str) -> Column:
        return F.get_json_object("manifest", path).cast("bigint").alias(name)

    def length(name: str) -> Column:
        return F.json_array_length(F.get_json_object("manifest", f"$.{name}")).cast("bigint").alias(name)

    names = F.json_object_keys(F.get_json_object("manifest", "$.leader_names"))
    return doc.select(
        *[number(f"$.{c}", c) for c in ("rows_fec_sets", "min_slot", "max_slot")],
        *[number(f"$.counters.{c}", c) for c in _ALL_COUNTERS],
        *[length(c) for c in ("notes", "txn_compare", "provider_pings")], F.size(names).cast("bigint").alias("leader_names"),
        F.get_json_object("manifest", "$.txn_compare[0].source").alias("first_source"))


def _manifest_check() -> str:
    def value(expression: str, name: str, where: str = "true") -> str:
        return f"(SELECT CAST(coalesce({expression}, 0) AS BIGINT) FROM ({CHECKS[name]}) q WHERE {where})"

    numbers = {c: value("sum(packets)", "packet_verdicts", f"verdict = '{v}'") for c, v in quality.OF_VERDICT.items()}
    numbers |= {c: f"(SELECT count(*) FROM events WHERE event_id % {k} = 0)" for c, k in _CAPTURE.items()}
    numbers |= {"udp_unmatched": value("sum(datagrams)", "rule_match", "provider IS NULL"),
                "udp_kernel_dropped": value("sum(dropped)", "socket_losses"), "shreds_after_window": value("sum(late)", "stream_late_packets")}
    numbers |= {c: value(f"sum({c})", "set_rows") for c in ("invalid_sig", "invalid_data", "invalid_unknown")}
    counters = ", ".join(f"{sql} AS {c}" for c, sql in numbers.items())
    noted = " + ".join(f"CAST({c} > 0 AS BIGINT)" for c, _ in quality.NOTES)
    return f"""
SELECT rows_fec_sets, min_slot, max_slot, c.*, {noted} AS notes, {value("count(*)", "txn_race")} AS txn_compare,
       {value("count(*)", "provider_pings")} AS provider_pings, {value("count(*)", "leader_names", "name IS NOT NULL")} AS leader_names,
       (SELECT min(source) FROM ({CHECKS["txn_race"]}) q) AS first_source
FROM ({CHECKS["archive_extent"]}) x CROSS JOIN (SELECT {counters}) c"""


CHECKS["full_manifest"] = _manifest_check()
