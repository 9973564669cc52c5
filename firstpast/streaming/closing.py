"""Closing slots of a packet stream by the slots of accepted packets.

The tip of the stream is the highest slot of a packet that passed its checks, so neither a forged
slot nor a corrupt packet can close anything. A batch closes the slots in
(old tip - wait, new tip - wait] and hands their packets to a batch operator: those that come with the batch, and those
that wait in the shared folder (``waiting``). Only packets whose slot stays open are written to wait, in folders
that are named in the state row and removed when their slots are closed. Packets at or below the old cutoff come
too late; they are counted one by one and dropped.

Every batch writes folders of its own and overwrites them on replay, and a batch sees only what earlier
ones left, so a restarted query gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from firstpast.operators import sets, txns
from firstpast.streaming import sinks, waiting
from firstpast.streaming.waiting import State

# Fixed values.
WAIT_SLOTS = 10
RETIRE_SLOTS = 64
# Slots in one bucket of waiting packets, and buckets in one folder.
WIDTH = 256
SPAN = 256


def plausible() -> Column:
    return (F.col("slot") >= 0) & (F.col("slot") < sets.MAX_PLAUSIBLE_SLOT)


def bucket_of(slot: str | int) -> Column:
    return F.floor((F.col(slot) if isinstance(slot, str) else F.lit(slot)) / F.lit(float(WIDTH))).cast("bigint")


def land(packets: DataFrame, path: str, batch_id: int) -> None:
    """Add packets to a table of waiting ones, in a folder per ``SPAN`` buckets.

    Files follow the rows and not the tasks that they come from; sorted by bucket, a reader skips what it does not want of a file.
    """
    bucket = bucket_of("slot")
    (packets.withColumns({"bucket": bucket, "span": F.floor(bucket / F.lit(float(SPAN))).cast("bigint")})
     .hint("rebalance", "span").sortWithinPartitions("span", "slot").write.mode("overwrite").partitionBy("span")
     .parquet(f"{path}/batch={batch_id}"))


def _landed_table(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame:
    fields = StructType([*schema.fields]).add("bucket", "long").add("batch", "long").add("span", "long")
    return spark.read.schema(fields).parquet(path).filter(F.col("batch") <= batch_id)


def of_buckets(spark: SparkSession, path: str, schema: StructType, batch_id: int, wanted: list[int]) -> DataFrame:
    """Rows of these buckets, of the batches up to ``batch_id``."""
    spans = sorted({b // SPAN for b in wanted})
    table = _landed_table(spark, path, schema, batch_id)
    return table.filter(F.col("span").isin(spans) & F.col("bucket").isin(wanted)).drop("batch", "bucket", "span")


def buckets(spark: SparkSession, path: str, schema: StructType, batch_id: int, above: int | None, upto: int | None) -> DataFrame:
    """Rows of the buckets that hold slots in (above, upto], of the batches up to ``batch_id``."""
    found = _landed_table(spark, path, schema, batch_id)
    if above is not None:
        low = (above + 1) // WIDTH
        found = found.filter((F.col("span") >= low // SPAN) & (F.col("bucket") >= low))
    if upto is not None:
        high = upto // WIDTH
        found = found.filter((F.col("span") <= high // SPAN) & (F.col("bucket") <= high))
    return found.drop("batch", "bucket", "span")


def landed(spark: SparkSession, path: str, schema: StructType, batch_id: int, above: int | None, upto: int | None) -> DataFrame:
    """Landed packets of the batches up to ``batch_id`` with slots in (above, upto]; other buckets are not read."""
    found = buckets(spark, path, schema, batch_id, above, upto)
    if above is not None:
        found = found.filter(F.col("slot") > above)
    return found if upto is None else found.filter(F.col("slot") <= upto)


def late_packets(spark: SparkSession, store: str) -> int:
    """Packets that came for a closed slot, each copy counted."""
    return waiting.last_state(spark, store).late


def _latest(*slots: int | None) -> int | None:
    return max((s for s in slots if s is not None), default=None)


def closing(store: str, out: str, run: Callable[[DataFrame], DataFrame], accepted: Column,
            wait: int = WAIT_SLOTS) -> sinks.BatchFunction:
    """A batch function that writes ``run`` of the packets of every slot once, when the slot closes."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = waiting.settle(spark, store, batch_id)
        cutoff = None if before.tip is None else before.tip - wait
        late = F.lit(False) if cutoff is None else F.col("slot") <= cutoff
        rows = batch.filter(plausible())
        # The batch's own slots and verdicts are read first: then no packet is written that this batch closes.
        seen = rows.agg(F.max(F.when(accepted & ~late, F.col("slot"))).alias("tip"), F.count_if(late).alias("late")).first()
        tip = _latest(before.tip, seen.tip)
        fresh, kept, closed = rows.filter(~late), before.open, ()
        if tip is not None and (cutoff is None or tip - wait > cutoff):
            upto = tip - wait
            due = [p for p in before.open if p.low <= upto]
            inside = waiting.within(F.col("slot"), cutoff, upto)
            closes = fresh.filter(inside)
            if due:
                closes = closes.unionByName(waiting.read(spark, store, batch.schema, due).filter(inside))
            sinks.put_batch(run(closes), out, batch_id)
            fresh = fresh.filter(F.col("slot") > upto)
            closed = tuple(p for p in before.open if p.high <= upto)
            kept = tuple(p for p in before.open if p.high > upto)
        kept += waiting.put(fresh, store, batch_id, tip)
        # Last, so that a batch that dies before it is done is done again from the same state.
        waiting.write_state(spark, store, batch_id, State(tip, before.late + seen.late, kept, closed))

    return process


def drain(spark: SparkSession, schema: StructType, store: str, out: str, run: Callable[[DataFrame], DataFrame],
          wait: int = WAIT_SLOTS) -> None:
    """Close every slot that is still open, once the stream has ended."""
    last = waiting.last_batch(spark, store)
    if last is None:
        return
    state = waiting.read_state(spark, store, last)
    rest = waiting.read(spark, store, schema, state.open)
    if state.tip is not None:
        rest = rest.filter(F.col("slot") > state.tip - wait)
    sinks.put_batch(run(rest), out, last + 1)


# -- sets ------------------------------------------------------------------------

def set_rows_stream(packets: DataFrame, out: str, checkpoint: str, wait: int = WAIT_SLOTS, every: str | None = None,
                    store: str | None = None) -> StreamingQuery:
    """Write the result rows of every closed slot to ``out``; ``drain_set_rows`` writes the rest."""
    write = closing(store or f"{checkpoint}-store", out, sets.set_rows, sets.acceptance() == "ok", wait)
    return sinks.start(packets, write, checkpoint, every)


def drain_set_rows(spark: SparkSession, schema: StructType, out: str, checkpoint: str, wait: int = WAIT_SLOTS,
                   store: str | None = None) -> None:
    drain(spark, schema, store or f"{checkpoint}-store", out, sets.set_rows, wait)


# -- transactions ------------------------------------------------------------------

_OPEN = "signature string, source string, ns bigint, known_ns bigint, known_slot bigint"


def _merged(sightings: DataFrame) -> DataFrame:
    """One row per (signature, source): its first time, and the earliest sighting that names a slot."""
    known = F.min(F.when(F.col("known_slot") != 0, F.struct("known_ns", "known_slot")))
    return (sightings.groupBy("signature", "source").agg(F.min("ns").alias("ns"), known.alias("known"))
            .select("signature", "source", "ns", "known.known_ns", "known.known_slot"))


def _with_slot(sightings: DataFrame) -> DataFrame:
    """Attach the slot that the signature's first sighting with a slot names, from whichever source."""
    with_slot = F.when(F.col("known_slot").isNotNull(), F.struct("known_ns", "known_slot"))
    named = (sightings.groupBy("signature").agg(F.min(with_slot).alias("named"))
             .select("signature", F.col("named.known_slot").alias("signature_slot")))
    return sightings.join(named, "signature")


def retiring(store: str, out: str, retire: int = RETIRE_SLOTS) -> sinks.BatchFunction:
    """A batch function that scores a signature once, when its slot is more than ``retire`` behind the tip.

    What is still open is written anew by every batch: the sightings of some ``retire`` slots, and those without a slot,
    which wait for the drain.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = waiting.settle(spark, store, batch_id)
        for name in ("all", "open"):
            waiting.remove(spark, f"{store}/{name}/batch={batch_id - 2}")
        possible = batch.filter(plausible())
        tip = _latest(before.tip, possible.agg(F.max("slot")).first()[0])
        new = possible.select("signature", "source", "ns", F.col("ns").alias("known_ns"),
                              F.when(F.col("slot") != 0, F.col("slot")).alias("known_slot"))
        held = spark.read.schema(_OPEN).parquet(f"{store}/open/batch={batch_id - 1}") if batch_id else None
        path = f"{store}/all/batch={batch_id}"
        _merged(new if held is None else new.unionByName(held)).write.mode("overwrite").parquet(path)
        slotted = _with_slot(spark.read.schema(_OPEN).parquet(path))
        done = F.lit(False) if tip is None else F.coalesce(F.col("signature_slot") < tip - retire, F.lit(False))
        sinks.put_batch(txns.raced_signatures(slotted.filter(done)), out, batch_id)
        (slotted.filter(~done).select(*[c.split()[0] for c in _OPEN.split(", ")])
         .write.mode("overwrite").parquet(f"{store}/open/batch={batch_id}"))
        waiting.write_state(spark, store, batch_id, State(tip))

    return process


def txn_race_stream(events: DataFrame, out: str, checkpoint: str, retire: int = RETIRE_SLOTS,
                    every: str | None = None) -> StreamingQuery:
    """Write the scored sightings of retired signatures to ``out``; ``drain_txn_race`` writes the rest.

    Totals and percentiles are taken over the written table (``txns.totals_of``), so
    they cover the whole run.
    """
    return sinks.start(events, retiring(f"{checkpoint}-store", out, retire), checkpoint, every)


def drain_txn_race(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Score every signature that is still open, those without a slot included."""
    store = f"{checkpoint}-store"
    last = waiting.last_batch(spark, store)
    if last is not None:
        rest = spark.read.schema(_OPEN).parquet(f"{store}/open/batch={last}")
        sinks.put_batch(txns.raced_signatures(rest), out, last + 1)
