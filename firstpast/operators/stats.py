"""Per-source statistics of baseline races and simple arrival reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.functions.numeric import exact_sum, mean_ms, ms, percent
from firstpast.operators.percentiles import delay_bin, percentile_columns, running_total
from firstpast.operators.race import HUB_RACE, count_before

QUANTILES = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}
# Ranks inside one race are counted per millisecond of delay first.
_RANK_BLOCK_NS = 1_000_000


def _won() -> Column:
    return F.when(F.col("rank") == 0, F.col("n")).otherwise(F.lit(0))


def per_source_stats(ranked: DataFrame, time: str = "delta_ns") -> DataFrame:
    """Samples, wins, win rate, rank, delays, percentiles and coverage per (hub, source).

    Everything comes from one pass: counts and sums per (hub, source, delay bin),
    folded up to (hub, source). Every race has exactly one winner, so the races
    of a hub are the sum of its wins and need no second scan.
    """
    bins = (ranked.groupBy("hub", "source", delay_bin(time).alias("bin"))
            .agg(F.count("*").alias("n"),
                 F.count_if(F.col("rank") == 0).alias("wins"),
                 F.sum("rank").alias("sum_rank"),
                 exact_sum(time).alias("sum_d"),
                 F.min(time).alias("min_d"), F.max(time).alias("max_d"),
                 F.count_if(F.col(time) < 0).alias("neg")))
    by = ["hub", "source"]
    stats = (bins.withColumn("cum", running_total(by, "bin", "n"))
             .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
             .groupBy(*by)
             .agg(F.sum("n").alias("samples"), F.sum("wins").alias("win_count"),
                  F.sum("sum_rank").alias("sum_rank"), F.sum("sum_d").alias("sum_d"),
                  F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d"),
                  F.sum("neg").alias("neg"),
                  *percentile_columns(QUANTILES, "cum", "total", "bin")))
    races = F.sum("win_count").over(Window.partitionBy("hub"))
    return stats.withColumn("races", races).select(
        *by, "samples", "win_count",
        percent("win_count", "races").alias("win_rate_pct"),
        (F.col("sum_rank").cast("double") / F.col("samples")).alias("avg_rank"),
        mean_ms("sum_d", "samples").alias("avg_delta_ms"),
        *QUANTILES,
        ms("min_d").alias("min_ms"), ms("max_d").alias("max_ms"),
        percent("neg", "samples").alias("beats_baseline_pct"),
        percent("samples", "races").alias("coverage_pct"))


def races_per_hub(ranked: DataFrame) -> DataFrame:
    """Races per hub: each race has exactly one rank-0 row."""
    return (ranked.filter(F.col("rank") == 0)
            .groupBy("hub").agg(F.count("*").alias("races")))


def leader_split(totals: DataFrame) -> DataFrame:
    """Per (hub, leader's brand, source): how each source did on that brand's slots.

    ``totals`` is ``dims.slot_totals``. Slots and sets of a brand are summed over its
    few source rows: each slot has one leading row, each set one winner.
    """
    of_brand = Window.partitionBy("hub", "leader_provider")
    return (totals.filter(F.col("leader_provider").isNotNull())
            .groupBy("hub", "leader_provider", "source")
            .agg(F.sum("samples").alias("samples"), F.sum("wins").alias("wins"),
                 F.sum("sum_d").alias("sum_d"), F.count_if("lead").alias("slots_led"))
            .withColumn("slots_seen", F.sum("slots_led").over(of_brand))
            .withColumn("fec_sets", F.sum("wins").over(of_brand))
            .select("hub", "leader_provider", "slots_seen", "fec_sets", "source", "samples", "wins",
                    percent("wins", "fec_sets").alias("win_rate_pct"),
                    mean_ms("sum_d", "samples").alias("avg_delta_ms")))


def own_vs_other(totals: DataFrame, registered: DataFrame, brand: Column) -> DataFrame:
    """Each registered source on its own brand's slots against all other slots.

    ``totals`` is ``dims.slot_totals`` with a leader brand, ``registered`` holds the
    brands with known leader keys, ``brand`` maps a source to its brand.
    """
    known = registered.select(F.col("brand").alias("source_brand")).distinct()
    kind = (F.when(F.col("leader_provider").eqNullSafe(F.col("source_brand")), "own")
            .otherwise("other"))
    return (totals.withColumn("source_brand", brand)
            .withColumn("slots_kind", kind)
            .groupBy("hub", "source", "source_brand", "slots_kind")
            .agg(F.sum("samples").alias("samples"), F.sum("wins").alias("wins"),
                 F.sum("sum_d").alias("sum_d"))
            .join(known, "source_brand", "left_semi")
            .select("hub", "source", "slots_kind", "samples", "wins",
                    percent("wins", "samples").alias("win_rate_of_samples_pct"),
                    mean_ms("sum_d", "samples").alias("avg_delta_ms")))


def daily_trend(arrivals: DataFrame, time: str = "delta_ns") -> DataFrame:
    """Per (day, hub, source): samples, mean delay and share ahead of the baseline."""
    return (arrivals.filter(F.col(time).isNotNull())
            .groupBy(F.to_date("t").alias("day"), "hub", "source")
            .agg(F.count("*").alias("samples"), exact_sum(time).alias("sum_d"),
                 F.count_if(F.col(time) < 0).alias("neg"))
            .select("day", "hub", "source", "samples",
                    mean_ms("sum_d", "samples").alias("avg_delta_ms"),
                    percent("neg", "samples").alias("beats_baseline_pct")))


def first_provider_share(firsts: DataFrame) -> DataFrame:
    """Per (hub, src_ip): how often it was first, its share of the hub, and the window."""
    counts = (firsts.groupBy("hub", "src_ip")
              .agg(F.count("*").alias("first_count"), F.min("t").alias("window_start"),
                   F.max("t").alias("window_end")))
    # Summed from the counts. The window's ends are kept, though not needed, so that both
    # readers of the counts share one scan and one exchange.
    totals = (counts.groupBy("hub")
              .agg(F.sum("first_count").alias("hub_total"), F.min("window_start").alias("from"), F.max("window_end").alias("to"),
                   F.max("src_ip").alias("ip"))
              .filter(F.coalesce(F.col("from") <= F.col("to"), F.lit(True)) & (F.coalesce("ip", F.lit("")) >= ""))
              .select("hub", "hub_total"))
    return (counts.join(totals, "hub")
            .select("hub", "src_ip", "first_count",
                    percent("first_count", "hub_total").alias("first_share_pct"),
                    "window_start", "window_end"))


def baseline_signatures(arrivals: DataFrame, baselines: Sequence[str],
                        time: str = "delta_ns") -> DataFrame:
    """One authentic signature per race: the baseline's own, where it has one.

    Reduced to one row per race before any join, so two baseline rows of a race
    cannot double its arrivals. The baseline's rows are picked inside the aggregate: as a filter they would
    be sought in a scan of their own.
    """
    own = (F.col(time) == 0) & F.col("source").isin(list(baselines)) & F.col("signature").isNotNull()
    return (arrivals.groupBy(*HUB_RACE).agg(F.max(F.when(own, F.col("signature"))).alias("true_signature"))
            .filter(F.col("true_signature").isNotNull()))


def with_baseline_signature(arrivals: DataFrame, baselines: Sequence[str],
                            time: str = "delta_ns") -> DataFrame:
    """Arrivals of the races whose baseline delivered a signature, with it attached."""
    return (arrivals.filter(F.col(time).isNotNull())
            .join(baseline_signatures(arrivals, baselines, time), list(HUB_RACE)))


def signature_panel(arrivals: DataFrame, baselines: Sequence[str],
                    time: str = "delta_ns") -> DataFrame:
    """Race statistics over signature-valid arrivals, plus wrong and absent signatures.

    Arrivals are not reduced to one per source here, so a race may hold any number
    of rows: equal arrivals are counted together first, and ranks among the valid
    ones are counted block by block.
    """
    same = (arrivals.filter(F.col(time).isNotNull())
            .groupBy(*HUB_RACE, "source", time, "signature").agg(F.count("*").alias("n")).filter(F.col("n") > 0))
    signature = F.coalesce("signature", F.lit(""))
    good = F.col("verdict") == "valid"
    judged = (with_baseline_signature(same, baselines, time)
              .withColumn("verdict", F.when(signature == F.col("true_signature"), "valid")
                          .when(signature == "", "none").otherwise("bad"))
              .groupBy(*HUB_RACE, "source", time)
              .agg(F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n"),
                   F.sum(F.when(F.col("verdict") == "bad", F.col("n")).otherwise(0)).alias("bad"),
                   F.sum(F.when(F.col("verdict") == "none", F.col("n")).otherwise(0)).alias("none")))
    # Arrivals without a valid signature weigh nothing in the ranking.
    ranked = count_before(judged, HUB_RACE, [time, "source"],
                          F.floor(F.col(time) / F.lit(float(_RANK_BLOCK_NS))), "n")
    valid = F.col("n") > 0
    # n equal arrivals take the ranks before, before + 1, ..., before + n - 1.
    rank_sum = (F.col("before") * F.col("n")
                + F.floor(F.col("n") * (F.col("n") - 1) / F.lit(2.0)).cast("bigint"))
    by = ["hub", "source"]
    bins = (ranked.groupBy(*by, F.when(valid, delay_bin(time)).alias("bin"))
            .agg(F.sum("n").alias("n"),
                 F.count_if(valid & (F.col("before") == 0)).alias("wins"),
                 F.sum(rank_sum).alias("sum_rank"),
                 exact_sum(F.col(time) * F.col("n")).alias("sum_d"),
                 F.sum(F.when(F.col(time) < 0, F.col("n")).otherwise(0)).alias("neg"),
                 F.sum("bad").alias("bad"), F.sum("none").alias("none")))
    panel = (bins.withColumn("cum", running_total(by, "bin", "n"))
             .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
             .groupBy(*by)
             .agg(F.sum("n").alias("valid_samples"), F.sum("wins").alias("win_count"),
                  F.sum("sum_rank").alias("sum_rank"), F.sum("sum_d").alias("sum_d"), F.sum("neg").alias("neg"),
                  F.sum("bad").alias("bad_sig_count"), F.sum("none").alias("no_sig_count"),
                  *percentile_columns(QUANTILES, "cum", "total", "bin")))
    sets = (baseline_signatures(same, baselines, time)
            .groupBy("hub").agg(F.count("*").alias("sets")))
    arrived = F.col("valid_samples") + F.col("bad_sig_count") + F.col("no_sig_count")
    return panel.join(sets, "hub").select(
        *by, "valid_samples", "win_count",
        percent("win_count", "sets").alias("win_rate_pct"),
        F.when(F.col("valid_samples") > 0, F.col("sum_rank").cast("double") / F.col("valid_samples"))
        .alias("avg_rank"),
        F.when(F.col("valid_samples") > 0, mean_ms("sum_d", "valid_samples")).alias("avg_delta_ms"),
        *QUANTILES,
        percent("neg", "valid_samples").alias("beats_baseline_pct"),
        percent("valid_samples", "sets").alias("valid_coverage_pct"),
        "bad_sig_count", "no_sig_count",
        percent(F.col("bad_sig_count"), arrived).alias("bad_sig_pct_of_arrivals"))


def signature_mismatches(panel: DataFrame) -> DataFrame:
    """The sources of a signature panel with any wrong or absent signature."""
    return (panel.filter((F.col("bad_sig_count") > 0) | (F.col("no_sig_count") > 0))
            .select("hub", "source", F.col("valid_samples").alias("valid"),
                    F.col("bad_sig_count").alias("bad_signature"),
                    F.col("no_sig_count").alias("no_signature")))
