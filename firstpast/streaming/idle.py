"""State that ends when its key falls silent: lives of slots.

``ended_lives`` goes batch by batch and keeps the open lives as a table, so it takes batches of any size; ``idle_slots`` keeps
them by key with timers on event time, for streams with few slots at a time.

A slot lives from its first packet until ``ttl`` passed without one; then what is known of it is written, its state is
dropped, and a packet that comes later begins a new life. Time is the packets' own, so a replayed batch and a
restarted query give the same rows. Packets may come late by the watermark's delay: a slot keeps every life that such a
packet could still reach, and joins lives when one lies between them. ``idle_slots`` needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from firstpast.streaming.sinks import BatchFunction, put_batch
from firstpast.streaming.waiting import read_note, remove, write_note

# Fixed values.
SLOT_TTL_SECS = 20
SEEN_LIMIT = 100_000

_LIFE = "first_ns bigint, last_ns bigint, packets bigint"
_LIVES = "lives array<struct<first_ns:bigint,last_ns:bigint,packets:bigint>>"

Life = tuple[int, int, int]


def joined_lives(lives: Iterable[Life], ttl_ns: int) -> list[Life]:
    """Lives in order of time, those less than ``ttl_ns`` apart as one."""
    out: list[Life] = []
    for first, last, packets in sorted(lives):
        if out and first - out[-1][1] < ttl_ns:
            before = out.pop()
            first, last, packets = before[0], max(before[1], last), before[2] + packets
        out.append((first, last, packets))
    return out


class Lives(StatefulProcessor):
    """The lives of one slot that are not over; a timer at the end of each."""

    def __init__(self, ttl_secs: int) -> None:
        self.ttl_ns = ttl_secs * 1_000_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lives = handle.getValueState("lives", _LIVES)

    def _open(self) -> list[Life]:
        return [tuple(int(v) for v in life) for life in self.lives.get()[0]] if self.lives.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [life for batch in rows for life in zip(batch["first_ns"].tolist(), batch["last_ns"].tolist(), batch["packets"].tolist())]
        lives = joined_lives([*self._open(), *fresh], self.ttl_ns)
        self.lives.update((lives,))
        for _, last, _ in lives:
            # The first millisecond at which the slot has been silent for long enough.
            self.handle.registerTimer(-(-(last + self.ttl_ns) // 1_000_000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1_000_000
        lives = self._open()
        over = [life for life in lives if life[1] + self.ttl_ns <= now]
        left = [life for life in lives if life[1] + self.ttl_ns > now]
        if left:
            self.lives.update((left,))
        elif lives:
            self.lives.clear()
        if over:
            first, last, packets = zip(*over)
            yield pd.DataFrame({"slot": [int(key[0])] * len(over), "first_ns": first, "last_ns": last, "packets": packets})

    def close(self) -> None:
        pass


def _lives_of_batch(ttl_ns: int):
    """Packets of a slot inside an Arrow batch as lives, so that a busy slot sends few rows to its state."""
    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for slot, times in batch.groupby("slot")["rx_ns"]:
                rows += [(slot, *life) for life in joined_lives([(t, t, 1) for t in times.tolist()], ttl_ns)]
            made = pd.DataFrame(rows, columns=["slot", "first_ns", "last_ns", "packets"])
            # A life counts as late by its first packet, as the packet by itself would.
            made["at"] = pd.to_datetime(made["first_ns"], unit="ns").dt.floor("us")
            yield made

    return reduce


def idle_slots(packets: DataFrame, ttl_secs: int = SLOT_TTL_SECS, delay_secs: int = 1) -> DataFrame:
    """``(slot, first_ns, last_ns, packets)`` of every life of a slot, once it is over."""
    reduced = packets.select("slot", "rx_ns").mapInPandas(
        _lives_of_batch(ttl_secs * 1_000_000_000), f"slot bigint, {_LIFE}, at timestamp")
    return (reduced.withWatermark("at", f"{delay_secs} seconds").groupBy("slot")
            .transformWithStateInPandas(statefulProcessor=Lives(ttl_secs), outputStructType=f"slot bigint, {_LIFE}",
                                        outputMode="append", timeMode="EventTime"))


def merged_lives(lives: DataFrame, key: tuple[str, ...], ttl_ns: int) -> DataFrame:
    """Lives of a key that are less than ``ttl_ns`` apart as one, over the whole table."""
    in_order = Window.partitionBy(*key).orderBy("first_ns", "last_ns")
    before = F.max("last_ns").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first_ns") - F.col("before"), F.lit(ttl_ns)) >= ttl_ns
    return (lives.withColumn("before", before)
            .withColumn("life", F.count_if(begins).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*key, "life")
            .agg(F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.sum("packets").alias("packets"))
            .drop("life"))


def ended_lives(store: str, out: str, key: tuple[str, ...] = ("slot",), ttl_secs: int = SLOT_TTL_SECS, delay_secs: int = 1,
                at: str = "rx_ns") -> BatchFunction:
    """A batch function that writes ``(*key, first_ns, last_ns, packets)`` of every life once, when it is over.

    The clock is the latest time of any packet; a life is over once the clock is ``ttl_secs`` and ``delay_secs`` past its last packet.
    Packets more than ``delay_secs`` behind the clock of the batch before come too late and are dropped; a note counts them. What is open is
    written by every batch and read by the next one.
    """
    ttl, delay = ttl_secs * 1_000_000_000, delay_secs * 1_000_000_000

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_note(spark, f"{store}/clock/batch={batch_id - 1}") if batch_id else {"now": None, "late": 0}
        for name in ("lives", "clock"):
            remove(spark, f"{store}/{name}/batch={batch_id - 2}")
        timed = batch.filter(F.col(at).isNotNull())
        late = F.lit(False) if before["now"] is None else F.col(at) < before["now"] - delay
        seen = timed.agg(F.max(at).alias("now"), F.count_if(late).alias("late")).first()
        now = max((t for t in (before["now"], seen["now"]) if t is not None), default=None)
        # Packets inside one stretch of this length are of one life, so a busy key sends a row per stretch and task.
        stretch = (F.col(at) - F.pmod(F.col(at), F.lit(ttl))).alias("stretch")
        fresh = (timed.filter(~late).groupBy(*key, stretch)
                 .agg(F.min(at).alias("first_ns"), F.max(at).alias("last_ns"), F.count("*").alias("packets")).drop("stretch"))
        kept = StructType([*fresh.schema.fields]).add("over", "boolean")
        held = spark.read.schema(kept).parquet(f"{store}/lives/batch={batch_id - 1}").filter("NOT over") if batch_id else None
        lives = merged_lives(fresh if held is None else fresh.unionByName(held.drop("over")), key, ttl)
        over = F.lit(False) if now is None else F.col("last_ns") <= now - delay - ttl
        path = f"{store}/lives/batch={batch_id}"
        lives.withColumn("over", over).write.mode("overwrite").partitionBy("over").parquet(path)
        put_batch(spark.read.schema(kept).parquet(path).filter("over").drop("over"), out, batch_id)
        write_note(spark, f"{store}/clock", f"batch={batch_id}", {"now": now, "late": before["late"] + seen["late"]})

    return process


def seen_once(out: str, key: str, limit: int = SEEN_LIMIT) -> BatchFunction:
    """A batch function that passes each key on once, as long as it is remembered.

    What has been seen is a table that every batch writes anew; once it holds more than ``limit`` keys it is
    emptied, so that it stays bounded and a key may pass again.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        keys = batch.select(key).filter(F.col(key).isNotNull()).distinct()
        seen = f"{out}-seen"
        before = spark.read.schema(keys.schema).parquet(f"{seen}/batch={batch_id - 1}") if batch_id else None
        put_batch(keys if before is None else keys.join(before, key, "left_anti"), out, batch_id)
        now = spark.read.schema(keys.schema).parquet(f"{out}/batch={batch_id}")
        known = now if before is None else now.union(before)
        put_batch(known.filter(F.lit(known.count() <= limit)), seen, batch_id)
        remove(spark, f"{seen}/batch={batch_id - 2}")

    return process
