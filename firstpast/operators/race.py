"""Race ranking under the three race definitions.

* baseline race  -- key (hub, slot, fec_set_index), stored delta to one baseline
  source, ties broken by source name, a lone finisher still wins;
* anchored race  -- key (slot, fec_set_index), times relative to the baseline
  provider's or else the earliest;
* contested race -- at least two finishers, every finisher tied at the earliest
  time wins, times are "behind the earliest".

A race never holds more than one row per source once reduced by
``first_per_source``, so windows over a race stay small even when one race
received a large share of all arrivals; the reduction itself combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUB_RACE = ("hub", "slot", "fec_set_index")
SET_RACE = ("slot", "fec_set_index")


def first_per_source(df: DataFrame, key: Sequence[str] = HUB_RACE, source: str = "source",
                     time: str = "delta_ns") -> DataFrame:
    """Earliest arrival of each source in each race; later rows are dropped."""
    return (df.filter(F.col(time).isNotNull())
            .groupBy(*key, source).agg(F.min(time).alias(time)))


def race_rank(df: DataFrame, key: Sequence[str] = HUB_RACE, source: str = "source",
              time: str = "delta_ns") -> DataFrame:
    """0-based finishing position, ties broken by source name."""
    order = Window.partitionBy(*key).orderBy(F.col(time), F.col(source))
    return df.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))


def ranked_races(arrivals: DataFrame, key: Sequence[str] = HUB_RACE, source: str = "source",
                 time: str = "delta_ns") -> DataFrame:
    """One row per (race, source) with its rank: the table all race reports share."""
    return race_rank(first_per_source(arrivals, key, source, time), key, source, time)


def first_bucket_arrivals(arrivals: DataFrame, width: str, key: Sequence[str] = HUB_RACE,
                          source: str = "source", time: str = "delta_ns",
                          stamp: str = "t") -> DataFrame:
    """First arrival per (race, source), counting only each race's earliest time bucket.

    A race whose rows straddle a bucket boundary is taken from the earlier bucket
    only. Rows are reduced to (race, source, bucket) before the window, so the
    window sees sources x buckets per race rather than raw arrivals.
    """
    bucket = F.window(F.col(stamp).cast("timestamp"), width)["start"]
    per_bucket = (arrivals.filter(F.col(time).isNotNull())
                  .groupBy(*key, source, bucket.alias("bucket"))
                  .agg(F.min(time).alias(time)))
    race_start = F.min("bucket").over(Window.partitionBy(*key))
    return (per_bucket.withColumn("race_bucket", race_start)
            .filter(F.col("bucket") == F.col("race_bucket"))
            .drop("race_bucket"))


def first_bucket_only(df: DataFrame, width: str, key: Sequence[str] = HUB_RACE,
                      stamp: str = "t") -> DataFrame:
    """All rows of each race's earliest time bucket, unreduced.

    The earliest bucket per race is an aggregate joined back on the race key, so
    a hot race is split by the skew join instead of landing in one window.
    """
    bucket = F.window(F.col(stamp).cast("timestamp"), width)["start"]
    keyed = df.withColumn("bucket", bucket)
    first = keyed.groupBy(*key).agg(F.min("bucket").alias("bucket"))
    return keyed.join(first, [*key, "bucket"], "left_semi").drop("bucket")


def race_anchor(time: str, source: str, baseline: str | None,
                key: Sequence[str] = SET_RACE, fallback: str | None = None) -> Column:
    """The baseline's time in the race, else the earliest of ``fallback`` (or ``time``).

    Expects one row per (race, source).
    """
    race = Window.partitionBy(*key)
    earliest = F.min(fallback or time).over(race)
    if baseline is None:
        return earliest
    return F.coalesce(F.min(F.when(F.col(source) == baseline, F.col(time))).over(race), earliest)


def race_min(df: DataFrame, time: str, key: Sequence[str]) -> DataFrame:
    """Earliest time and number of finishers per race, over rows whose time is set.

    Expects one row per (race, source).
    """
    race = Window.partitionBy(*key)
    return (df.withColumn("win_ns", F.min(time).over(race))
            .withColumn("contestants", F.count(time).over(race)))


def count_before(df: DataFrame, part: Sequence[str], order: Sequence[str], block: Column,
                 weight: str) -> DataFrame:
    """Sum of ``weight`` over the rows ordered strictly earlier within ``part``.

    Two levels keep any one window small when a single ``part`` holds a large share
    of the rows: rows are counted inside (part, block), blocks are counted inside
    part, and the two add up. ``block`` must grow with the first order column.
    """
    blocked = df.withColumn("block", block)
    inside = Window.partitionBy(*part, "block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*part).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = (blocked.groupBy(*part, "block").agg(F.sum(weight).alias("block_weight"))
              .withColumn("block_before", F.coalesce(F.sum("block_weight").over(earlier), F.lit(0)))
              .drop("block_weight"))
    rows = blocked.withColumn("before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (rows.join(blocks, [*part, "block"])
            .withColumn("before", F.col("before") + F.col("block_before"))
            .drop("block", "block_before"))
