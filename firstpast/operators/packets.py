"""Raw packets to judged packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.functions import binary as b
from firstpast.functions.numeric import saturating_sub
from firstpast.operators.dims import classify_slot


def parse_shreds(datagrams: DataFrame, payload: str = "payload") -> DataFrame:
    """Header columns of each packet; unreadable fields are NULL."""
    zero = F.lit(0).cast("bigint")
    head = datagrams.withColumn("header", b.header_hex(payload))
    fields = (head
              .withColumn("variant", b.le_uint("header", b.VARIANT_AT, 1))
              .withColumn("is_code", b.decode_variant(F.col("variant"))["is_code"])
              .withColumn("slot", b.le_uint("header", b.SLOT_AT, 8))
              .withColumn("shred_index", b.le_uint("header", b.INDEX_AT, 4))
              .withColumn("version", b.le_uint("header", b.VERSION_AT, 2))
              .withColumn("fec_set_index", b.le_uint("header", b.SET_INDEX_AT, 4)))
    code, data = F.col("is_code"), ~F.col("is_code")
    flags = b.le_uint("header", b.DATA_FLAGS_AT, 1)
    last = flags.bitwiseAND(F.lit(b.LAST_IN_SLOT_FLAGS)) == b.LAST_IN_SLOT_FLAGS
    complete = flags.bitwiseAND(F.lit(b.DATA_COMPLETE_FLAG)) != 0
    return (fields
            .withColumn("num_data", F.when(code, b.le_uint("header", b.CODE_NUM_DATA_AT, 2)))
            .withColumn("num_coding", F.when(code, b.le_uint("header", b.CODE_NUM_CODING_AT, 2)))
            .withColumn("position", F.when(code, b.le_uint("header", b.CODE_POSITION_AT, 2))
                        .when(data, saturating_sub(F.col("shred_index"), F.coalesce("fec_set_index", zero))))
            .withColumn("last_in_slot", data & last)
            .withColumn("data_complete", data & complete)
            .withColumn("payload_hash", F.sha2(payload, 256))
            .withColumn("data_hash", b.content_hash(payload, F.col("variant")))
            .drop("header"))


def classify_packets(parsed: DataFrame, schedule: DataFrame, first_slot: int, epoch_slots: int,
                     version: int | None = None, ping_ok: Column | None = None,
                     payload: str = "payload") -> DataFrame:
    """Attach ``verdict`` to every parsed packet; the first matching rule decides.

    too short -> malformed; a ping whose signature holds -> ping; another version ->
    wrong_version; an unknown variant -> unsupported; an implausible slot ->
    malformed; no leader known -> no_leader (kept); else parsed.

    ``ping_ok`` says whether a ping-shaped packet's signature holds. Without it no
    packet is called a ping, as the shape alone proves nothing.
    """
    known = classify_slot(parsed, schedule, first_slot, epoch_slots)
    short = F.length(F.col(payload)) < b.MIN_PACKET
    ping = F.lit(False) if ping_ok is None else b.is_ping_shape(payload) & F.coalesce(ping_ok, F.lit(False))
    other_version = F.lit(False) if version is None else F.col("version") != version
    unknown_variant = ~F.coalesce(b.variant_known(F.col("variant")), F.lit(False))
    implausible = F.col("slot").isNull() | (F.col("slot_verdict") == "implausible")
    verdict = (F.when(short, "malformed").when(ping, "ping")
               .when(other_version, "wrong_version").when(unknown_variant, "unsupported")
               .when(implausible, "malformed")
               .when(F.col("slot_verdict") == "unknown", "no_leader").otherwise("parsed"))
    return known.withColumn("verdict", verdict).drop("slot_verdict")


def verdict_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("verdict").agg(F.count("*").alias("packets"))


TRIPLE = ("signature", "root", "leader")
VerifyOne = Callable[[object, object, object], bool]
VerifyBatch = Callable[[pd.DataFrame], bool]


def verify_distinct(packets: DataFrame, verify_one: VerifyOne,
                    verify_batch: VerifyBatch | None = None) -> DataFrame:
    """Attach ``sig_ok``, checking each distinct (signature, root, leader) once.

    NULL where the root or leader is unknown. ``verify_batch`` may accept a whole
    batch at once; a rejected batch is checked one by one, so one bad signature
    condemns no other. Packets outnumber triples by far, and the verdict joined
    back is one row per triple.
    """
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if verify_batch is not None and verify_batch(batch):
                verdicts = [True] * len(batch)
            else:
                verdicts = [bool(verify_one(*row)) for row in batch[list(TRIPLE)].itertuples(index=False)]
            yield batch.assign(sig_ok=verdicts)

    triples = packets.select(*TRIPLE).dropna().distinct()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in triples.schema)
    checked = triples.mapInPandas(check, f"{fields}, sig_ok boolean")
    return packets.join(checked, list(TRIPLE), "left")
