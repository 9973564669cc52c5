"""Header fields of binary packets, read with column expressions.

The header is turned to hex text once per packet; every field is a slice of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public wire layout: byte offsets, little-endian integers.
SIGNATURE_LEN = 64
VARIANT_AT = 64
SLOT_AT = 65
INDEX_AT = 73
VERSION_AT = 77
SET_INDEX_AT = 79
DATA_FLAGS_AT = 85
CODE_NUM_DATA_AT = 83
CODE_NUM_CODING_AT = 85
CODE_POSITION_AT = 87
HEADER_END = 89
MIN_PACKET = 90
LAST_IN_SLOT_FLAGS = 0xC0
DATA_COMPLETE_FLAG = 0x40
DATA_PAYLOAD = 1203
CODE_PAYLOAD = 1228
ROOT_LEN = 32
PROOF_ENTRY_LEN = 20
PING_LEN = 132
PING_START = "04000000"
# High nibble of the variant byte -> (is_code, chained, resigned).
VARIANTS = {
    0x40: (True, False, False),
    0x60: (True, True, False),
    0x70: (True, True, True),
    0x80: (False, False, False),
    0x90: (False, True, False),
    0xB0: (False, True, True),
}


def header_hex(payload: str | Column) -> Column:
    """Bytes 64..89 of a packet as hex text."""
    column = F.col(payload) if isinstance(payload, str) else payload
    return F.hex(F.substring(column, SIGNATURE_LEN + 1, HEADER_END - SIGNATURE_LEN))


def le_uint(header: str | Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer at byte ``at``; NULL beyond a signed 64-bit value."""
    column = F.col(header) if isinstance(header, str) else header
    first = 2 * (at - SIGNATURE_LEN) + 1
    pairs = [F.substring(column, first + 2 * i, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).try_cast("bigint")


def le_hex(value: Column, size: int) -> Column:
    """Hex text of an integer's little-endian bytes."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


def variant_high(variant: Column) -> Column:
    return variant.bitwiseAND(F.lit(0xF0))


def variant_known(variant: Column) -> Column:
    return variant_high(variant).isin(*VARIANTS)


def _variant_flag(variant: Column, which: int) -> Column:
    yes = [high for high, flags in VARIANTS.items() if flags[which]]
    return F.when(variant_known(variant), variant_high(variant).isin(*yes))


def decode_variant(variant: Column) -> Column:
    """(is_code, proof_size, chained, resigned); fields are NULL for unknown variants."""
    return F.struct(
        _variant_flag(variant, 0).alias("is_code"),
        F.when(variant_known(variant), variant.bitwiseAND(F.lit(0x0F))).alias("proof_size"),
        _variant_flag(variant, 1).alias("chained"),
        _variant_flag(variant, 2).alias("resigned"))


def content_hash(payload: str | Column, variant: Column) -> Column:
    """SHA-256 of the authenticated content: headers and data without proof material.

    NULL for unknown variants and for packets too short to hold the content.
    """
    column = F.col(payload) if isinstance(payload, str) else payload
    parts = decode_variant(variant)
    zero = F.lit(0)
    end = (F.when(parts["is_code"], CODE_PAYLOAD).otherwise(DATA_PAYLOAD)
           - F.when(parts["chained"], ROOT_LEN).otherwise(zero)
           - parts["proof_size"] * PROOF_ENTRY_LEN
           - F.when(parts["resigned"], SIGNATURE_LEN).otherwise(zero)).cast("int")
    content = column.substr(F.lit(SIGNATURE_LEN + 1), end - SIGNATURE_LEN)
    return F.when((end > SIGNATURE_LEN) & (F.length(column) >= end), F.sha2(content, 256))


def is_ping_shape(payload: str | Column) -> Column:
    """Exactly a ping's length and leading discriminant."""
    column = F.col(payload) if isinstance(payload, str) else payload
    return (F.length(column) == PING_LEN) & (F.hex(F.substring(column, 1, 4)) == PING_START)
