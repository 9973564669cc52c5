"""Small numeric column helpers shared by the reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(col: str | Column) -> Column:
    """Sum of BIGINT nanoseconds that cannot overflow, whatever the row count."""
    column = F.col(col) if isinstance(col, str) else col
    return F.sum(column.cast("decimal(20,0)"))


def mean_ms(total: str, n: str) -> Column:
    return F.col(total).cast("double") / F.col(n) / F.lit(1e6)


def percent(part: str | Column, whole: str | Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def ms(ns: str | Column) -> Column:
    """Nanoseconds to milliseconds; NULL stays NULL."""
    column = F.col(ns) if isinstance(ns, str) else ns
    return column / F.lit(1e6)


def micros(ns: str | Column) -> Column:
    column = F.col(ns) if isinstance(ns, str) else ns
    return column / F.lit(1e3)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), a - b)


def wrapping_u32_diff(current: Column, previous: Column) -> Column:
    """Difference of two readings of a 32-bit counter that may have wrapped."""
    return F.pmod(current - previous, F.lit(4294967296).cast("bigint"))


def unix_ns(seconds: Column, nanos: Column) -> Column:
    return seconds.cast("bigint") * F.lit(1_000_000_000).cast("bigint") + nanos.cast("bigint")


def lenient_int(col: str | Column) -> Column:
    """Integer part of a number in text form; anything unreadable becomes NULL."""
    column = F.col(col) if isinstance(col, str) else col
    return column.try_cast("double").try_cast("bigint")


# -- tuples as one number ---------------------------------------------------------

_REST = 1 << 63


def packed(time: str | Column, *parts: tuple[Column, int]) -> Column:
    """``time`` and the parts behind it as one DECIMAL(38,0) that sorts like the tuple of them.

    A part lies in [0, size); the sizes' product is at most 2^63, and so is ``time``. A hash aggregate can keep the least
    of such numbers in place, while for the least struct that holds text Spark sorts.
    """
    rest, room = F.lit(0).cast("bigint"), 1
    for part, size in parts:
        rest, room = rest * F.lit(size) + part, room * size
    if room > _REST:
        raise ValueError("the parts need more than 63 bits")
    column = F.col(time) if isinstance(time, str) else time
    return column.cast("decimal(19,0)") * F.lit(Decimal(_REST)) + rest


def unpacked(number: str | Column, *sizes: int) -> list[Column]:
    """The parts of a packed number, given their sizes in the same order."""
    return parts_of(F.pmod(number, F.lit(Decimal(_REST))).cast("bigint"), *sizes)


def rest_of(number: str | Column, time: str | Column) -> Column:
    """What is packed behind a time that is known: a subtraction, where ``unpacked`` divides. ``parts_of`` takes it apart."""
    column = F.col(number) if isinstance(number, str) else number
    known = F.col(time) if isinstance(time, str) else time
    return (column - known.cast("decimal(19,0)") * F.lit(Decimal(_REST))).cast("bigint")


def parts_of(rest: str | Column, *sizes: int) -> list[Column]:
    """The parts of what is packed behind a time."""
    rest = F.col(rest) if isinstance(rest, str) else rest
    found = []
    for size in reversed(sizes):
        found.append(F.pmod(rest, F.lit(size).cast("bigint")))
        rest = F.call_function("div", rest, F.lit(size).cast("bigint"))
    return found[::-1]


def time_of(number: str | Column) -> Column:
    """The time of a packed number."""
    rest = F.pmod(number, F.lit(Decimal(_REST)))
    column = F.col(number) if isinstance(number, str) else number
    return F.call_function("div", column - rest, F.lit(Decimal(_REST)))


def leading_bytes(text: str, n: int) -> Column:
    """The first ``n`` bytes (7 at most) of a text as a number that sorts like them."""
    # The first n characters hold the first n bytes; the rest of a long text is left alone.
    digits = F.rpad(F.substring(F.hex(F.substring(text, 1, n)), 1, 2 * n), 2 * n, "0")
    return F.conv(digits, 16, 10).cast("bigint")


def code_of(text: str | Column, bits: int = 60) -> Column:
    """A number for a text, equal for equal texts: 0 for NULL, else a hash in [1, 2^bits]."""
    code = F.xxhash64(text).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    return F.when((F.col(text) if isinstance(text, str) else text).isNull(), F.lit(0).cast("bigint")).otherwise(code)
