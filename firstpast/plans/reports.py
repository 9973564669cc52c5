"""Report tables, their order, and the jobs that produce them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.functions.text import brand_of, utc_iso
from firstpast.operators import dims, h2h, race, sets, stats
from firstpast.session import materialize
from firstpast.sources import writers


def order_sources(df: DataFrame) -> DataFrame:
    return df.orderBy("hub", F.desc("win_count"), "source")


def order_leaders(df: DataFrame) -> DataFrame:
    return df.orderBy("hub", "leader_provider", F.desc("win_rate_pct"), "source")


def order_trend(df: DataFrame) -> DataFrame:
    return df.orderBy("day", "hub", "avg_delta_ms", "source")


def trend_pivot(trend: DataFrame, metric: str, sources: Sequence[str] | None = None) -> DataFrame:
    """A trend metric as (hub, day) rows with one column per source."""
    pivoted = trend.groupBy("hub", "day").pivot("source", list(sources) if sources else None)
    return pivoted.agg(F.first(metric))


def leader_breakdown(split: DataFrame, name_ip: DataFrame, asn: DataFrame) -> DataFrame:
    """How every source did in the slots of each leading brand, with the source's address, network and location."""
    return order_leaders(dims.enrich_sources(split, name_ip, asn)).select(
        "hub", "leader_provider", "slots_seen", "fec_sets", "source", "src_ip", "asn_dc", "dc_location", "samples", "wins",
        "win_rate_pct", "avg_delta_ms")


def write_meta(totals: DataFrame, ranked: DataFrame, path: str, window: tuple[dt.datetime, dt.datetime] | None = None,
               epochs: Sequence[int] = ()) -> None:
    """What a report covers: its window, epochs, races per hub and slots without a known leader, as one JSON row."""
    races = stats.races_per_hub(ranked).agg(F.map_from_entries(F.collect_list(F.struct("hub", "races")))).scalar()
    meta = dims.unknown_leader_slots(totals).withColumn("fec_sets_per_hub", races)
    meta = meta.withColumn("epochs", F.array(*map(F.lit, epochs)).cast("array<bigint>"))
    if window:
        start, end = window
        meta = (meta.withColumn("window", F.array(utc_iso(F.lit(start)), utc_iso(F.lit(end))))
                .withColumn("window_hours", F.lit((end - start).total_seconds() / 3600))
                .withColumn("generated_utc", utc_iso(F.lit(end))))
    meta.write.mode("overwrite").json(f"{path}/meta")


def performance_report(arrivals: DataFrame, schedule: DataFrame, brands: DataFrame, path: str,
                       baselines: Sequence[str], trend_arrivals: DataFrame | None = None,
                       source_brand: Column | None = None, firsts: DataFrame | None = None,
                       providers: DataFrame | None = None, interest: DataFrame | None = None,
                       window: tuple[dt.datetime, dt.datetime] | None = None, epochs: Sequence[int] = ()) -> None:
    """All reports over a window of arrivals, as CSV directories under ``path``.

    ``firsts`` with ``providers`` adds the share of first deliveries per address, ``interest`` the coverage
    of watched addresses.

    The arrivals, their ranking and each table that goes to more than one file are worked out once, written to the shared
    folder and read again.
    """
    arrivals = materialize(arrivals, "arrivals")
    ranked = materialize(race.ranked_races(arrivals), "ranked")
    per_source = materialize(stats.per_source_stats(ranked), "per-source")
    totals = materialize(dims.slot_totals(ranked, schedule, brands), "slot-totals")
    own = materialize(stats.own_vs_other(totals, brands, source_brand if source_brand is not None else brand_of("source")), "own")
    pairs = h2h.head_to_head(ranked)
    panel = materialize(stats.signature_panel(arrivals, baselines), "panel")

    writers.write_report_csv(order_sources(per_source), path, "per_source")
    writers.write_report_csv(pairs, path, "head_to_head", "hub", "source_a", "source_b")
    writers.write_report_csv(order_leaders(stats.leader_split(totals)), path, "leader_slots")
    writers.write_report_csv(own, path, "own_vs_other", "hub", "source", "slots_kind")
    trend = stats.daily_trend(trend_arrivals if trend_arrivals is not None else arrivals)
    writers.write_report_csv(order_trend(trend), path, "daily_trend")
    writers.write_report_csv(order_sources(panel), path, "signature_panel")
    writers.write_report_csv(stats.signature_mismatches(panel), path, "signature_mismatch", "hub", "source")
    writers.write_per_brand(per_source, own, f"{path}/per_brand")
    if firsts is not None and providers is not None:
        share = dims.name_ips(stats.first_provider_share(firsts), providers)
        writers.write_report_csv(share, path, "first_provider", "hub", F.desc("first_count"), "src_ip")
        if interest is not None:
            covered = dims.coverage(interest, providers, arrivals.filter("delta_ns IS NOT NULL"), firsts)
            writers.write_report_csv(covered, path, "ip_coverage", "group", "ip")
    write_meta(totals, ranked, path, window, epochs)


def capture_archive(shreds: DataFrame, path: str, rotate_secs: int = 600, dump_shreds: bool = False) -> None:
    """Set rows of a capture as rotated archives, plus the optional packet dump."""
    writers.write_rotated(materialize(sets.set_rows(shreds), "set-rows"), f"{path}/fec_sets", rotate_secs)
    if dump_shreds:
        writers.write_shreds(shreds, f"{path}/shreds")
