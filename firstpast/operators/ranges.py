"""Completed ranges of a slot and the time their contents became readable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Indices are 32 bits wide: at most 2**16 blocks of at most 2**16 rows per slot.
_BLOCK = 1 << 16


def distinct_indices(shreds: DataFrame) -> DataFrame:
    """One row per (provider, slot, index): first arrival, and whether it closes a range."""
    return (shreds.groupBy("provider", "slot", "shred_index")
            .agg(F.min("rx_ns").alias("rx_ns"), F.max("data_complete").alias("data_complete")))


def completed_ranges(shreds: DataFrame) -> DataFrame:
    """Ranges (previous boundary, boundary] with every index present.

    ``ready_ns`` is the latest first arrival in the range. Rows after the last
    boundary belong to no range.

    Each row takes the nearest boundary at or after it and the nearest before it.
    They are looked up inside blocks of indices and, beyond a block's own
    boundaries, over the blocks, so a slot of any size is spread over many windows.
    """
    slot = ["provider", "slot"]
    block = F.floor(F.col("shred_index") / F.lit(float(_BLOCK))).cast("bigint").alias("block")
    boundary = F.when(F.col("data_complete"), F.col("shred_index"))
    over_blocks = Window.partitionBy(*slot).orderBy("block")
    # Straight from the packets: one row per block leaves a task.
    around = (shreds.groupBy(*slot, block).agg(F.min(boundary).alias("first_end"), F.max(boundary).alias("last_end"))
              .select(*slot, "block",
                      F.min("first_end").over(over_blocks.rowsBetween(1, Window.unboundedFollowing)).alias("later_end"),
                      F.max("last_end").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1))
                      .alias("earlier_end")))
    inside = Window.partitionBy(*slot, "block").orderBy("shred_index")
    labelled = (distinct_indices(shreds).withColumn("block", block)
                .withColumn("own_end", F.min(boundary).over(
                    inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
                .withColumn("own_before", F.max(boundary).over(
                    inside.rowsBetween(Window.unboundedPreceding, -1)))
                .join(around, [*slot, "block"])
                .withColumn("range_end", F.coalesce("own_end", "later_end"))
                .withColumn("range_start", F.coalesce("own_before", "earlier_end", F.lit(-1)) + 1)
                .filter(F.col("range_end").isNotNull()))
    return (labelled.groupBy(*slot, "range_end")
            .agg(F.max("range_start").alias("range_start"), F.count("*").alias("packets"),
                 F.max("rx_ns").alias("ready_ns"))
            .filter(F.col("packets") == F.col("range_end") - F.col("range_start") + 1)
            .select(*slot, "range_start", "range_end", "packets", "ready_ns"))


def txn_readable_at(txns: DataFrame, ranges: DataFrame) -> DataFrame:
    """Attach to each transaction the moment its range was complete, per provider.

    Transactions carry the exclusive end of the range they came in, so this is an
    equality join on (slot, end).
    """
    return (txns.withColumn("range_end", F.col("range_end_exclusive") - 1)
            .join(ranges.select("provider", "slot", "range_end", "ready_ns"), ["slot", "range_end"])
            .drop("range_end"))
