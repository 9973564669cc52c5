"""Closing sets by age, by completeness or by timeout, whichever comes first.

``closing_sets`` goes by the packets' own times, so a replayed batch and a restarted query close the same sets;
``finalize_timeout`` goes by the clock of the machine and closes a set within a second of its time, also when no packets come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from firstpast.operators.sets import anchored_set_stats
from firstpast.streaming import waiting
from firstpast.streaming.closing import bucket_of, of_buckets, plausible
from firstpast.streaming.sinks import BatchFunction, put_batch, write_batch
from firstpast.streaming.slots import guard_slots

# Fixed values.
GRACE_MS = 3000
TIMEOUT_GRACES = 4
WAIT_SLOTS = 10
CHECK_MS = 1000

_MARKS = "slot bigint, fec_set_index bigint, last_in_slot boolean, slot_time timestamp"
_CLOSED = "slot bigint, fec_set_index bigint, reason string, open_ms bigint"


# -- by the packets' own times -------------------------------------------------------

_SETS = "slot bigint, fec_set_index bigint, first_ns bigint, ended boolean, reason int"
REASONS = ("aged", "complete", "timed out")


def closing_sets(store: str, out: str, accepted: Column, at: str = "rx_ns", grace_ms: int = GRACE_MS,
                 wait_slots: int = WAIT_SLOTS) -> BatchFunction:
    """A batch function that writes ``(slot, set, reason, open_ms)`` once per set.

    The clock is the latest time of any packet, the tip the highest slot of an accepted one. What is open, a row per set, is
    written anew by every batch; a closed set stays in it until it is too old for any packet to be taken.
    """
    grace = grace_ms * 1_000_000
    key = ["slot", "fec_set_index"]

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = waiting.read_note(spark, f"{store}/clock/batch={batch_id - 1}") if batch_id else {"tip": None, "now": None}
        for name in ("sets", "clock"):
            waiting.remove(spark, f"{store}/{name}/batch={batch_id - 2}")
        in_time = F.lit(True) if before["tip"] is None else F.col("slot") > before["tip"] - wait_slots
        rows = batch.filter(plausible() & in_time)
        seen = rows.agg(F.max(F.when(accepted, F.col("slot"))).alias("tip"), F.max(at).alias("now")).first()
        tip, now = (max((t for t in (before[c], seen[c]) if t is not None), default=None) for c in ("tip", "now"))
        marks = rows.groupBy(*key).agg(F.min(at).alias("first_ns"), F.max(F.coalesce("last_in_slot", F.lit(False))).alias("ended"))
        marks = marks.withColumn("reason", F.lit(None).cast("int"))
        if batch_id:
            marks = marks.unionByName(spark.read.schema(_SETS).parquet(f"{store}/sets/batch={batch_id - 1}"))
        sets_ = marks.groupBy(*key).agg(F.min("first_ns").alias("first_ns"), F.max("ended").alias("ended"), F.max("reason").alias("reason"))
        aged = F.lit(False) if tip is None else F.col("slot") <= tip - wait_slots
        open_ns = F.lit(now).cast("bigint") - F.col("first_ns")
        reason = (F.when(aged, 0).when(F.col("ended") & (open_ns >= grace), 1).when(open_ns >= grace * TIMEOUT_GRACES, 2))
        decided = sets_.withColumn("now_closed", F.when(F.col("reason").isNull(), reason))
        named = F.element_at(F.array(*map(F.lit, REASONS)), F.col("now_closed") + 1)
        put_batch(decided.filter("now_closed IS NOT NULL").select(
            *key, named.alias("reason"), F.floor(open_ns / F.lit(1e6)).cast("bigint").alias("open_ms")), out, batch_id)
        put_batch(decided.filter(~aged).select(*key, "first_ns", "ended", F.coalesce("reason", "now_closed").alias("reason")),
                  f"{store}/sets", batch_id)
        waiting.write_note(spark, f"{store}/clock", f"batch={batch_id}", {"tip": tip, "now": now})

    return process


# -- by the machine's clock ------------------------------------------------------------

def set_marks(packets: DataFrame) -> DataFrame:
    """What closing needs to know of the packets: the set and whether its slot ended.

    Repeats are dropped inside every Arrow batch before the shuffle, so a flooded
    set sends a couple of rows per batch to its state, not its packets.
    """
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates(["slot", "fec_set_index", "last_in_slot"])

    marks = packets.select("slot", "fec_set_index",
                           F.coalesce("last_in_slot", F.lit(False)).alias("last_in_slot"),
                           F.timestamp_seconds("slot").alias("slot_time"))
    return marks.mapInPandas(reduce, _MARKS)


class CloseSets(StatefulProcessor):
    """Keeps when a set was first seen and whether its slot ended; rechecks every second."""

    def __init__(self, grace_ms: int, wait_slots: int) -> None:
        self.grace_ms = grace_ms
        self.wait_slots = wait_slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "first_ms bigint, ended boolean, done boolean")

    def _reason(self, slot: int, first_ms: int, ended: bool, now_ms: int, watermark_ms: int) -> str | None:
        # The watermark trails the highest slot by wait - 1 slots; see slots.py.
        if (slot + 1) * 1000 <= watermark_ms:
            return "aged"
        if ended and now_ms - first_ms >= self.grace_ms:
            return "complete"
        if now_ms - first_ms >= self.grace_ms * TIMEOUT_GRACES:
            return "timed out"
        return None

    def _check(self, key, timer_values) -> Iterator[pd.DataFrame]:
        first_ms, ended, done = self.opened.get()
        if done:
            return
        slot, fec = int(key[0]), int(key[1])
        now = timer_values.getCurrentProcessingTimeInMs()
        reason = self._reason(slot, first_ms, ended, now, timer_values.getCurrentWatermarkInMs())
        if reason is None:
            self.handle.registerTimer(now + CHECK_MS)
            return
        # The closed mark stays for as long again, so stragglers open no second row.
        self.opened.update((first_ms, ended, True))
        self.handle.registerTimer(now + self.grace_ms * TIMEOUT_GRACES)
        yield pd.DataFrame({"slot": [slot], "fec_set_index": [fec], "reason": [reason],
                            "open_ms": [now - first_ms]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended = any(bool(batch["last_in_slot"].any()) for batch in rows)
        if self.opened.exists():
            first_ms, was_ended, done = self.opened.get()
            if ended and not was_ended:
                self.opened.update((first_ms, True, done))
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.opened.update((now, ended, False))
        self.handle.registerTimer(now + CHECK_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.opened.exists():
            return
        if self.opened.get()[2]:
            self.opened.clear()
            return
        yield from self._check(key, timerValues)

    def close(self) -> None:
        pass


def finalize_timeout(packets: DataFrame, grace_ms: int = GRACE_MS, wait_slots: int = WAIT_SLOTS) -> DataFrame:
    """(slot, set, reason) once per set, when the set should be finalized.

    Needs the RocksDB state store. Statistics of a closed set are computed by the
    batch operators from the landed packets of that set.
    """
    marks = set_marks(guard_slots(packets))
    return (marks.withWatermark("slot_time", f"{wait_slots - 1} seconds")
            .groupBy("slot", "fec_set_index")
            .transformWithStateInPandas(
                statefulProcessor=CloseSets(grace_ms, wait_slots), outputStructType=_CLOSED,
                outputMode="append", timeMode="ProcessingTime"))


def set_stats_sink(packets_path: str, packet_schema: StructType, out: str, baseline: str | None,
                   version: int | None = None) -> BatchFunction:
    """A batch function for closed sets: their statistics, from their landed packets.

    ``packets_path`` holds packets by batch and bucket of slots (``closing.land``); the buckets of the closed slots are read,
    so that a slot far away adds one bucket and not all up to it.
    """
    def write(closed: DataFrame, batch_id: int) -> None:
        # Read by two branches of the statistics; the state store should answer once.
        keys = closed.select("slot", "fec_set_index").persist()
        try:
            own = [row[0] for row in keys.select(bucket_of("slot")).distinct().collect()]
            if not own:
                return
            packets = of_buckets(closed.sparkSession, packets_path, packet_schema, 1 << 62, own)
            of_closed = packets.join(keys, ["slot", "fec_set_index"], "left_semi")
            write_batch(anchored_set_stats(of_closed, baseline, version), out, batch_id)
        finally:
            keys.unpersist()

    return write
