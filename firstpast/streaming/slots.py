"""Streams that keep their state in Spark: settled slots, first sightings, static enrichment.

One slot is one second of event time where a watermark counts slots. Slots are closed by accepted
packets only, see ``closing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstpast.operators.dims import plausible_range
from firstpast.streaming.closing import plausible


def guard_slots(stream: DataFrame, first_slot: int | None = None, epoch_slots: int = 0) -> DataFrame:
    """Drop slots that cannot be real before they reach the watermark.

    Spark's watermark moves with every row, so a forged slot must not get there;
    with a schedule only slots around its epoch pass.
    """
    possible = plausible()
    if first_slot is not None:
        low, high = plausible_range(first_slot, epoch_slots)
        possible = possible & (F.col("slot") >= low) & (F.col("slot") < high)
    return stream.filter(possible)


def settled_slots(packets: DataFrame, quiet_secs: int = 1) -> DataFrame:
    """(provider, slot) pairs that had no packet for ``quiet_secs``, by arrival time.

    A session window merges map-side, so a busy slot ships partial sessions, not
    packets.
    """
    timed = (packets.withColumn("rx_time", F.timestamp_micros(F.floor(F.col("rx_ns") / F.lit(1e3)).cast("bigint")))
             .withWatermark("rx_time", f"{quiet_secs} seconds"))
    return (timed.groupBy(F.session_window("rx_time", f"{quiet_secs} seconds").alias("session"), "provider", "slot")
            .agg(F.count("*").alias("packets"), F.min("rx_ns").alias("first_ns"), F.max("rx_ns").alias("last_ns")))


def first_sightings(stream: DataFrame, key: str, time: str, ttl_secs: int = 20) -> DataFrame:
    """First row per key; a key is forgotten ``ttl_secs`` after it was last relevant."""
    return stream.withWatermark(time, f"{ttl_secs} seconds").dropDuplicatesWithinWatermark([key])


def enrich_static(stream: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach the slot's leader from a schedule table, NULL where unknown."""
    return stream.join(schedule.select("slot", "leader"), "slot", "left")
