"""Binary packets: parsing, verdict order, content hash, verifying distinct triples."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from firstpast.operators import dims, packets, quality


def packet(variant=0x96, slot=100, index=5, version=7, fec=3, flags=0, code=(2, 3, 4), size=None, fill=1):
    head = bytes([fill]) * 64 + bytes([variant]) + struct.pack("<QIHI", slot, index, version, fec)
    is_code = variant & 0xF0 in (0x40, 0x60, 0x70)
    head += struct.pack("<HHH", *code) if is_code else struct.pack("<HBHB", 0, flags, 0, 0)
    return (head + bytes([fill]) * 1300)[:size or (1228 if is_code else 1203)]


def parsed(spark, *payloads):
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "n int, payload binary")
    return packets.parse_shreds(df)


def test_header_fields(spark):
    data, code = parsed(spark, packet(flags=0xC0), packet(0x66, slot=2**40 + 1, version=65535)).orderBy("n").collect()
    assert (data.slot, data.shred_index, data.version, data.fec_set_index, data.position) == (100, 5, 7, 3, 2)
    assert (data.is_code, data.last_in_slot, data.data_complete, data.num_data) == (False, True, True, None)
    assert (code.slot, code.version, code.num_data, code.num_coding, code.position) == (2**40 + 1, 65535, 2, 3, 4)
    assert (code.is_code, code.last_in_slot) == (True, False)


def test_flags_alone(spark):
    row = parsed(spark, packet(flags=0x40)).first()
    assert (row.last_in_slot, row.data_complete) == (False, True)


def test_slot_beyond_64_bit_signed_is_unreadable(spark):
    assert parsed(spark, packet(slot=2**63)).first().slot is None


@pytest.mark.parametrize("variant, end", [
    (0x40, 1228), (0x66, 1228 - 32 - 120), (0x71, 1228 - 32 - 20 - 64), (0x80, 1203), (0x96, 1203 - 32 - 120),
    (0xB2, 1203 - 32 - 40 - 64)])
def test_content_hash_covers_headers_and_data_only(spark, variant, end):
    raw = packet(variant)
    assert parsed(spark, raw).first().data_hash == hashlib.sha256(raw[64:end]).hexdigest()


def test_content_hash_needs_the_whole_content(spark):
    rows = parsed(spark, packet(0x96, size=1051), packet(0x96, size=1050), packet(0xA5)).orderBy("n").collect()
    assert [r.data_hash is None for r in rows] == [False, True, True]


def ping(valid_tail=0, byte64=0x80):
    raw = bytearray(struct.pack("<I", 4) + bytes(128))
    raw[64] = byte64
    raw[77:79] = struct.pack("<H", 7)
    raw[65:73] = b"\xff" * 8
    return bytes(raw)


def verdicts(spark, payloads, ping_ok=True, version=7):
    schedule = spark.createDataFrame([(100, "L")], "slot long, leader string")
    df = packets.classify_packets(parsed(spark, *payloads), schedule, 100, 1, version, F.lit(ping_ok))
    return [r.verdict for r in df.orderBy("n").collect()]


def test_first_matching_rule_decides(spark):
    got = verdicts(spark, [packet(size=89), ping(), packet(version=8, variant=0xA5), packet(variant=0xA5),
                           packet(variant=0xC3), packet(slot=10**12), packet(slot=101), packet()])
    assert got == ["malformed", "ping", "wrong_version", "unsupported", "unsupported", "malformed", "no_leader", "parsed"]


@pytest.mark.parametrize("byte64", [0x80, 0x40])
def test_a_ping_is_never_a_packet(spark, byte64):
    assert verdicts(spark, [ping(byte64=byte64)]) == ["ping"]
    assert verdicts(spark, [ping(byte64=byte64)], ping_ok=False) == ["malformed"]


def test_triples_are_verified_once(spark):
    rows = [("s1", "r", "L")] * 3 + [("s2", "r", "L"), ("s1", None, "L"), ("s1", "r", None)]
    df = spark.createDataFrame(rows, "signature string, root string, leader string").withColumn("n", F.monotonically_increasing_id())
    calls = spark.sparkContext.accumulator(0)

    def verify(signature, root, leader):
        calls.add(1)
        return signature == "s1"

    checked = packets.verify_distinct(df, verify, verify_batch=lambda batch: False)
    got = sorted((r.signature, r.root is None, r.leader is None, str(r.sig_ok)) for r in checked.collect())
    assert got == [("s1", False, False, "True")] * 3 + [("s1", False, True, "None"), ("s1", True, False, "None"), ("s2", False, False, "False")]
    assert calls.value == 2


def test_notes_name_only_counters_above_zero(spark):
    counters = spark.createDataFrame([(0, 3, 2)], "udp_unmatched long, invalid_sig long, shreds_no_leader long")
    got = quality.quality_notes(counters).orderBy("position").collect()
    assert [(r.counter, r.value) for r in got] == [("invalid_sig", 3), ("shreds_no_leader", 2)]
    assert got[0].note == "signed content under a wrong proof: 3 packets"


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_counter_deltas_wrap(spark, width):
    readings = [(0, 5), (7, 5), (15, 2**32 - 1), (20, 3), (300, 4)]
    df = spark.createDataFrame([("s", t, v) for t, v in readings], "socket string, at long, reading long")
    got = quality.counter_deltas(df, F.floor(F.col("at") / width)).orderBy("at").collect()
    assert [r.delta for r in got] == [5, 0, 2**32 - 6, 4, 1]


def test_leader_window(spark):
    schedule = spark.range(0, 10_000).select(F.col("id").alias("slot"), F.lit("L").alias("leader"))
    window = dims.leader_window(schedule, 5000).agg(F.min("slot"), F.max("slot")).first()
    assert window[:] == (4700, 6500)
