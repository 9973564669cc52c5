"""Registered queries against their SQL, plan shape, and the report jobs."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from firstpast import schema, session
from firstpast.operators import race, sets, stats
from firstpast.plans import reports
from firstpast.plans.written import CHECKS, QUERIES
from firstpast.plans.views import spark_view

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import compare  # noqa: E402

# The streamed scoreboard is the streamed set rows plus an operator tested on its own.
NAMES = [n for n in QUERIES if n != "stream_scoreboard"]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    text, agrees = compare.compare(spark, con, sf_dir, name)
    assert agrees, text


@pytest.fixture(scope="module")
def wide_dir(sf_dir, tmp_path_factory):
    """The smallest tables three times, with slots from 0, 900,000 and 1,100,000 on."""
    path = tmp_path_factory.mktemp("wide")
    for table in Path(sf_dir).glob("*.parquet"):
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(table.stem)
        rows = f"SELECT * FROM '{table}'" if key is None else (
            f"SELECT t.* REPLACE ({key} + 4 * o AS {key}) FROM (SELECT unnest([0, 900000, 1100000]) AS o) x CROSS JOIN '{table}' t")
        duckdb.sql(f"COPY ({rows}) TO '{path}/{table.name}' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["stream_forged_slots", "packet_verdicts"])
def test_query_agrees_where_slots_pass_a_million(spark, wide_dir, name):
    con = duckdb.connect()
    for path in Path(wide_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    text, agrees = compare.compare(spark, con, wide_dir, name)
    assert agrees, text


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert not __spark_entry__.entry(spark).isEmpty()


# -- invariants ----------------------------------------------------------------

def test_wins_of_all_sources_are_the_races(spark, sf_dir):
    ranked = race.ranked_races(spark_view(spark, sf_dir, "arrivals_delta"))
    wins = {r[0]: r[1] for r in stats.per_source_stats(ranked).groupBy("hub").agg(F.sum("win_count")).collect()}
    assert wins == {r.hub: r.races for r in stats.races_per_hub(ranked).collect()}


def test_pairs_add_up(spark, sf_dir):
    rows = __spark_entry__.queries()["head_to_head"](spark, sf_dir).collect()
    led = {(r.hub, r.source_a, r.source_b): r.a_first_count for r in rows}
    assert all(r.a_first_count + led.get((r.hub, r.source_b, r.source_a), 0) == r.both_present for r in rows)


def test_split_sums_to_invalid_everywhere(spark, sf_dir):
    rows = sets.set_rows(spark_view(spark, sf_dir, "shreds"))
    assert rows.filter("invalid <> invalid_sig + invalid_data + invalid_unknown").isEmpty()


# -- plans ---------------------------------------------------------------------

def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan


def test_set_rows_scan_packets_once(spark, sf_dir):
    plan = final_plan(sets.set_rows(spark_view(spark, sf_dir, "shreds")))
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


@pytest.mark.parametrize("name", ["set_rows", "invalid_split", "retransmits", "anchored_set_stats", "provider_counters", "delay_histogram"])
def test_sets_aggregate_by_hash_over_one_scan(spark, sf_dir, name):
    """First copies, sizes and arrivals are kept as numbers, so no aggregate sorts its input."""
    # The query of set_rows joins the leaders of the slots, a table of their own.
    df = sets.set_rows(spark_view(spark, sf_dir, "shreds")) if name == "set_rows" else __spark_entry__.queries()[name](spark, sf_dir)
    plan = final_plan(df)
    assert "SortAggregate" not in plan
    assert sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["set_rows", "truth_match", "anchored_set_stats"])
def test_payloads_are_grouped_as_numbers(spark, sf_dir, name):
    """No exchange goes by the text of a payload hash, and set rows gather no lists of arrivals."""
    plan = final_plan(__spark_entry__.queries()[name](spark, sf_dir))
    assert not any("hashpartitioning" in line and "payload_hash" in line for line in plan.splitlines())
    assert name != "set_rows" or "collect_list" not in plan


@pytest.mark.parametrize("name", ["set_rows", "provider_counters"])
def test_payload_ties_are_worked_out_once(spark, sf_dir, name):
    """No filter asks for the bytes that settle ties; the payload hash is known or the packet is left out."""
    plan = final_plan(__spark_entry__.queries()[name](spark, sf_dir))
    assert not any("Filter" in line and "conv(" in line for line in plan.splitlines())


def test_set_streams_land_what_set_rows_read(spark, sf_dir, monkeypatch):
    from firstpast.plans import catalog
    fed, landed = catalog._fed, []
    monkeypatch.setattr(catalog, "_fed", lambda parts, *rest: (landed.extend(parts[0].columns), fed(parts, *rest)))
    rows = catalog.stream_set_rows(spark, sf_dir)
    assert rows.count() == __spark_entry__.queries()["set_rows"](spark, sf_dir).count()
    assert "payload_hash" in landed and not {"root", "version"} & set(landed)


def test_counters_ask_for_no_positions(spark, sf_dir):
    assert "slot_position" not in final_plan(__spark_entry__.queries()["provider_counters"](spark, sf_dir))


@pytest.mark.parametrize("name", ["anchored_set_stats", "delay_histogram"])
def test_facts_of_a_set_need_no_join_of_their_own(spark, sf_dir, name):
    """Roots are reduced once; the only join attaches the facts to the payloads. Positions are folded without lists."""
    plan = final_plan(__spark_entry__.queries()[name](spark, sf_dir))
    assert sum("Join" in line for line in plan.splitlines()) == 1 and "collect_list" not in plan


def test_late_packets_are_counted_without_their_payloads(spark, sf_dir, monkeypatch):
    from firstpast.plans import catalog
    fed, landed = catalog._fed, []
    monkeypatch.setattr(catalog, "_fed", lambda parts, *rest: (landed.extend(parts[0].columns), fed(parts, *rest)))
    assert catalog.stream_late_packets(spark, sf_dir).first().late > 0
    assert "payload_hash" not in landed and {"slot", "merkle_ok", "sig_ok"} <= set(landed)


def test_head_to_head_forms_pairs_without_a_join(spark):
    ranked = spark.createDataFrame([("h", 1, 0, "a", 0)], "hub string, slot long, fec_set_index long, source string, rank long")
    from firstpast.operators.h2h import head_to_head
    assert "Join" not in final_plan(head_to_head(ranked))


@pytest.mark.parametrize("name", ["per_source_stats", "head_to_head", "set_rows", "contested_scoreboard", "txn_race",
                                  "completed_ranges", "signature_panel", "anchored_set_stats"])
def test_no_cross_join_and_no_forced_broadcast(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "strategy=broadcast" not in logical and "Cartesian" not in physical and "NestedLoop" not in physical


def test_hot_packet_is_split_by_the_skew_join(spark):
    """One packet with many failing copies: its join partition is split between tasks."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("p"), F.col("id") % 5).alias("provider"), F.lit(0).alias("rx_ns").cast("long"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("slot"),
        F.lit(0).cast("long").alias("fec_set_index"), F.lit(0).cast("long").alias("shred_index"),
        F.lit(False).alias("is_code"), F.lit(0).cast("long").alias("position"), F.lit(False).alias("last_in_slot"),
        F.lit(False).alias("data_complete"), F.lit(None).cast("long").alias("num_data"),
        F.lit(None).cast("long").alias("num_coding"), F.lit(None).cast("string").alias("leader"),
        (F.col("id") % 30 == 0).alias("sig_ok"), F.lit(True).alias("merkle_ok"),
        F.md5(F.col("id").cast("string")).alias("payload_hash"), F.md5((F.col("id") % 2).cast("string")).alias("data_hash"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        matched = sets.match_truth(sets.judged(rows))
        assert "skew=true" in final_plan(matched.groupBy("failure").count())
        counts = {r[0]: r[1] for r in matched.groupBy("failure").count().collect()}
    finally:
        for key in small:
            spark.conf.unset(key)
    assert counts["invalid_sig"] + counts["invalid_data"] > 60_000 and sum(counts.values()) == 200_000 - 6_667


# -- sessions and jobs ---------------------------------------------------------

def test_shared_folder_comes_from_the_session(spark, tmp_path):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    folder = session.shared_dir(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert session.working_path(spark, "x") != session.working_path(spark, "x")


def test_materialized_table_cuts_the_lineage(spark):
    df = session.materialize(spark.range(5).withColumn("x", F.col("id") + 1), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 5 and "Range" not in plan


def test_performance_report(spark, sf_dir, tmp_path):
    path = str(tmp_path / "report")
    reports.performance_report(spark_view(spark, sf_dir, "arrivals_delta"), spark_view(spark, sf_dir, "schedule"),
                               spark_view(spark, sf_dir, "leader_brands"), path, ["src-0"], source_brand=F.col("source"))
    table = spark.read.option("header", True).csv(f"{path}/per_source")
    assert table.count() == 16 and table.columns[:4] == ["hub", "source", "samples", "win_count"]
    wins = [(r.hub, -int(r.win_count)) for r in table.collect()]
    assert wins == sorted(wins)
    for name in ("head_to_head", "leader_slots", "own_vs_other", "daily_trend", "signature_panel"):
        assert not spark.read.option("header", True).csv(f"{path}/{name}").isEmpty()
    assert spark.read.json(f"{path}/meta").first().unknown_leader_slots > 0


def test_capture_archive(spark, sf_dir, tmp_path):
    shreds = spark_view(spark, sf_dir, "shreds").withColumn("leader", F.lit("L"))
    reports.capture_archive(shreds, str(tmp_path), 600, dump_shreds=True)
    assert spark.read.parquet(f"{tmp_path}/shreds").columns == schema.columns("shred_dump")
    assert spark.read.parquet(f"{tmp_path}/fec_sets").count() == sets.set_rows(shreds).count()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_archive_reads_set_rows_that_are_written(spark, sf_dir, monkeypatch):
    """An archive works its rows out twice, so they are no aggregate any more."""
    from firstpast.sources import writers

    plans, write = [], writers.write_rotated
    monkeypatch.setattr(writers, "write_rotated", lambda rows, *a, **k: (plans.append(_optimized(rows)), write(rows, *a, **k)))
    assert QUERIES["sets_archive"](spark, sf_dir).count() > 0
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_a_performance_report_works_its_tables_out_once(spark, sf_dir, monkeypatch):
    """What goes to several files is read back; the trend reads arrivals whose deltas are known."""
    from firstpast.sources import writers

    plans, write = {}, writers.write_report_csv
    monkeypatch.setattr(writers, "write_report_csv", lambda df, path, report, *o: (
        plans.update({report: _optimized(df)}), write(df, path, report, *o)))
    assert QUERIES["performance_files"](spark, sf_dir).count() == 9
    assert not [r for r in ("per_source", "own_vs_other", "signature_panel", "signature_mismatch") if "Aggregate" in plans[r]]
    assert "Join" not in plans["daily_trend"]
