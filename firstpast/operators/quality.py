"""Quality counters, the notes they give rise to, and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.functions.numeric import wrapping_u32_diff

# Counters in report order (names are fixed values), and how a report words one that is not zero. A counter is
# reported, never turned into a verdict about a source.
NOTES = (
    ("udp_no_timestamp", "receive time missing: %d datagrams are in no timing"),
    ("udp_channel_full", "intake overrun: %d batches lost, expect gaps"),
    ("udp_kernel_dropped", "lost by the receiving machine: %d datagrams that sources seem to have missed"),
    ("udp_truncated", "oversized: %d datagrams skipped"),
    ("shreds_unsupported_variant", "kind not understood: %d packets counted neither as good nor as bad"),
    ("udp_unmatched", "sender named by no rule: %d datagrams left out"),
    ("shreds_after_window", "too late for their set: %d packets that the set seems to lack"),
    ("invalid_data", "content other than the signed one: %d packets"),
    ("invalid_sig", "signed content under a wrong proof: %d packets"),
    ("invalid_unknown", "wrong proof and nothing signed to compare with: %d packets"),
    ("shreds_no_leader", "signer unknown: %d packets that cannot be judged"),
)


# Counters of a capture and of packet verdicts, in report order. Fixed values.
CAPTURED = ("udp_received", "udp_no_timestamp", "udp_channel_full", "udp_truncated")
OF_VERDICT = {"shreds_parsed": "parsed", "shreds_malformed": "malformed", "shreds_unsupported_variant": "unsupported",
              "non_shred_pings": "ping", "shreds_wrong_version": "wrong_version", "shreds_no_leader": "no_leader"}


def run_counters(capture: DataFrame, verdicts: DataFrame, matched: DataFrame, losses: DataFrame, late: DataFrame,
                 split: DataFrame) -> DataFrame:
    """All counters of a run as one row, each from the step that meets it.

    ``capture`` and ``split`` are one-row tables, ``late`` one number; ``verdicts`` (verdict, packets), ``matched``
    (provider, datagrams) and ``losses`` (socket, dropped) hold a row per verdict, per sender and per socket.
    """
    def total(column: str, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(F.lit(True) if when is None else when, F.col(column))), F.lit(0)).cast("bigint")

    row = verdicts.agg(*[total("packets", F.col("verdict") == v).alias(c) for c, v in OF_VERDICT.items()])
    beside = {
        **{c: capture.select(F.col(c).cast("bigint")) for c in CAPTURED},
        "udp_unmatched": matched.agg(total("datagrams", F.col("provider").isNull())),
        "udp_kernel_dropped": losses.agg(total("dropped")),
        "shreds_after_window": late.agg(total(late.columns[0])),
        **{c: split.select(c) for c in ("invalid_sig", "invalid_data", "invalid_unknown")},
    }
    return row.select("*", *[df.scalar().alias(c) for c, df in beside.items()])


def quality_notes(counters: DataFrame) -> DataFrame:
    """One row per counter above zero, in report order."""
    present = [(i, name, text) for i, (name, text) in enumerate(NOTES) if name in counters.columns]
    notes = F.array(*[F.when(F.col(name) > 0, F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("counter"),
        F.col(name).cast("bigint").alias("value"), F.format_string(text, F.col(name).cast("bigint")).alias("note")))
        for i, name, text in present])
    return (counters.select(F.explode(notes).alias("n")).filter(F.col("n").isNotNull())
            .select("n.position", "n.counter", "n.value", "n.note"))


def split_totals(rows: DataFrame) -> DataFrame:
    """The invalid split summed over set rows, as one counters row."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                      for c in ("invalid_sig", "invalid_data", "invalid_unknown")])


def archive_extent(rows: DataFrame) -> DataFrame:
    """Rows and slot range of a set-row table; the range of an empty one is 0..0."""
    return rows.agg(F.count("*").alias("rows_fec_sets"),
                    F.coalesce(F.min("slot"), F.lit(0)).alias("min_slot"),
                    F.coalesce(F.max("slot"), F.lit(0)).alias("max_slot"))


def counter_deltas(readings: DataFrame, block: Column, socket: str = "socket", at: str = "at",
                   value: str = "reading") -> DataFrame:
    """Increase since the previous reading of a cumulative 32-bit counter, per socket.

    The first reading counts from zero. ``block`` cuts time into pieces: readings
    are ordered inside a piece, and only each piece's last reading is carried over
    to the next, so a socket with a large share of the readings is spread out.
    """
    blocked = readings.withColumn("block", block)
    inside = Window.partitionBy(socket, "block").orderBy(at, value)
    last = (blocked.groupBy(socket, "block").agg(F.max(F.struct(at, value)).alias("last"))
            .withColumn("carried", F.lag("last").over(Window.partitionBy(socket).orderBy("block")))
            .select(socket, "block", F.col(f"carried.{value}").alias("carried")))
    zero = F.lit(0).cast("bigint")
    return (blocked.withColumn("previous", F.lag(value).over(inside))
            .join(last, [socket, "block"])
            .withColumn("previous", F.coalesce("previous", "carried", zero))
            .withColumn("delta", wrapping_u32_diff(F.col(value), F.col("previous")))
            .drop("block", "carried"))


def manifest(extent: DataFrame, counters: DataFrame, notes: DataFrame, sources: DataFrame | None = None,
             pings: DataFrame | None = None, names: DataFrame | None = None, **run: object) -> DataFrame:
    """One row with a nested JSON document describing a run.

    ``extent`` and ``counters`` are one-row tables; ``notes`` and ``sources`` (the comparison of transactions) hold a
    handful of rows, one per counter and one per source, ``pings`` one per address of a provider, ``names`` (leader, name) one per
    leader. They become arrays, the names an object without the leaders that have none.
    """
    def first_row(df: DataFrame) -> Column:
        return df.select(F.struct(*df.columns)).scalar()

    def listed(df: DataFrame, item: Column, *order: Column) -> Column:
        keyed = F.struct(F.struct(*order).alias("k"), item.alias("v"))
        return df.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["v"])).scalar()

    one = extent.select(*extent.columns,
                        first_row(counters).alias("counters"),
                        listed(notes, F.col("note"), F.col("position")).alias("notes"))
    for name, rows in (("txn_compare", sources), ("provider_pings", pings)):
        if rows is not None:
            one = one.withColumn(name, listed(rows, F.struct(*rows.columns), *map(F.col, rows.columns)))
    if names is not None:
        pair = F.struct("leader", "name")
        named = names.filter(F.col("leader").isNotNull() & F.col("name").isNotNull()).distinct()
        one = one.withColumn("leader_names", F.map_from_entries(listed(named, pair, F.col("leader"))))
    for name, value in run.items():
        one = one.withColumn(name, F.lit(value))
    return one.select(F.to_json(F.struct(*one.columns)).alias("manifest"))
