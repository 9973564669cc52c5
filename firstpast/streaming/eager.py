"""Acting on a stream batch by batch with small tables as memory.

State that the built-in stateful operators cannot express is kept in tables in
the shared folder, one directory per batch, so a replayed batch sees exactly what
it saw the first time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from firstpast.operators import ranges, txns
from firstpast.streaming.closing import land, of_buckets, plausible
from firstpast.streaming.sinks import BatchFunction, put_batch, write_batch
from firstpast.streaming.waiting import names_in, remove


_INDEX = "provider string, slot bigint, shred_index bigint, rx_ns bigint, data_complete boolean"
_RANGE = "provider string, slot bigint, range_start bigint, range_end bigint, packets bigint, ready_ns bigint"


def eager_ranges(store: str, out: str) -> BatchFunction:
    """Emit every completed range once, in the batch that fills it.

    Only slots touched by the batch are looked at again: indices and emitted ranges lie in folders by bucket of
    slots, and the buckets of the batch's own slots are read, so a forged slot adds one bucket and not all up to it. A range
    is contiguous, so no boundary inside it can still turn up: a completed range is final.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        indices = ranges.distinct_indices(batch.filter(plausible()))
        land(indices.select("provider", "slot", "shred_index", "rx_ns", "data_complete"), store, batch_id)
        kind = StructType.fromDDL(_INDEX)
        fresh = spark.read.schema(StructType([*kind.fields]).add("bucket", "long")).parquet(f"{store}/batch={batch_id}")
        # As many numbers as the batch has buckets of slots.
        own = [row[0] for row in fresh.select("bucket").distinct().collect()]
        if not own:
            return
        # Only rows of earlier batches are held against the slots of this one; its own belong to them anyway.
        earlier = of_buckets(spark, store, kind, batch_id - 1, own).join(fresh.select("provider", "slot"), ["provider", "slot"], "left_semi")
        filled = ranges.completed_ranges(fresh.select(*kind.names).unionByName(earlier))
        emitted_store = f"{store}-emitted"
        land(spark.createDataFrame([], _RANGE), emitted_store, -1)  # so that there is a table to read
        emitted = of_buckets(spark, emitted_store, StructType.fromDDL(_RANGE), batch_id - 1, own)
        write_batch(filled.join(emitted, ["provider", "slot", "range_end"], "left_anti")
                    .select("provider", "slot", "range_start", "range_end", "packets", "ready_ns"), out, batch_id)
        land(spark.read.schema(_RANGE).parquet(f"{out}/batch={batch_id}"), emitted_store, batch_id)

    return process


def throttled(out: str, key: str, time: str, gap: int, start: int = 0) -> BatchFunction:
    """Act at most once per ``gap`` and key. The last action of each key is one row, written anew by every batch."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        state = f"`{key}` {kind}, last_at bigint"
        # The batch before left one row per key; what it started from itself is no longer needed.
        last = spark.read.schema(state).parquet(f"{out}-last/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], state)
        remove(spark, f"{out}-last/batch={batch_id - 2}")
        scratch = f"{out}-levels/batch={batch_id}"
        put_batch(txns.throttle(batch, key, time, gap, start, last, scratch=scratch), out, batch_id)
        remove(spark, scratch)
        acted = spark.read.schema(f"`{key}` {kind}, `{time}` bigint").parquet(f"{out}/batch={batch_id}")
        now = acted.select(key, F.col(time).alias("last_at")).unionByName(last)
        (now.groupBy(key).agg(F.max("last_at").alias("last_at")).write.mode("overwrite")
         .parquet(f"{out}-last/batch={batch_id}"))

    return process


def enriched(out: str, schedule_path: str, epoch_slots: int, refresh: Callable[[SparkSession, int], None] | None = None,
             accepted: Column | None = None, refresh_all: Callable[[SparkSession, list[int]], None] | None = None) -> BatchFunction:
    """Attach leaders from a schedule in folders by epoch (``writers.replace_epoch``), of which a batch reads its own epochs.

    ``refresh(spark, epoch)`` is called for an epoch that accepted packets (without ``accepted``: all) name and the schedule lacks; it adds
    the epoch if it can. ``refresh_all(spark, epochs)`` stands in for it where one call can add several: a batch calls it once.
    Slots of an epoch that stays unknown have no leader.
    """
    epoch = F.floor(F.col("slot") / F.lit(float(epoch_slots))).cast("bigint")

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        def held() -> set[int]:
            return {int(name.partition("=")[2]) for name in names_in(spark, schedule_path) if name.startswith("epoch=")}

        known = held()
        trusted = F.lit(True) if accepted is None else accepted
        seen = batch.filter(plausible()).groupBy(epoch.alias("epoch")).agg(F.max(trusted).alias("trusted"))
        # Numbers of epochs, which last for days; forged ones that the schedule lacks stay away.
        wanted = {r.epoch for r in seen.filter(F.col("trusted") | F.col("epoch").isin(sorted(known))).collect()}
        missing = sorted(wanted - known)
        if refresh_all and missing:
            refresh_all(spark, missing)
        elif refresh:
            for one in missing:
                refresh(spark, one)
        if missing:
            known = held()
        paths = [f"{schedule_path}/epoch={e}" for e in sorted(wanted & known)]
        fields = "slot bigint, leader string"
        schedule = spark.read.schema(fields).parquet(*paths) if paths else spark.createDataFrame([], fields)
        write_batch(batch.join(schedule, "slot", "left"), out, batch_id)

    return process
