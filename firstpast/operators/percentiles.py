"""Exact percentiles over grouped counts.

Both operators shuffle counts, never rows, and cap what one window can hold, so a
source with a large share of all samples costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 20 us bins over +-100 ms.
BIN_NS = 20_000
LO_NS = -100_000_000
HI_NS = 100_000_000

# Nearest-rank search: a 63-bit value is resolved 21 bits at a time, so no window
# ever sees more than 2**21 distinct digits per group.
_DIGIT_BITS = 21
_SHIFTS = (42, 21, 0)


def delay_bin(time: str) -> Column:
    """Bin number of a delay, values outside the range clamped to the end bins."""
    clamped = F.least(F.greatest(F.col(time), F.lit(LO_NS)), F.lit(HI_NS - 1))
    return F.floor((clamped - F.lit(LO_NS)) / F.lit(float(BIN_NS))).cast("bigint")


def bin_midpoint_ms(bin_col: Column) -> Column:
    return (F.lit(float(LO_NS)) + (bin_col + F.lit(0.5)) * F.lit(float(BIN_NS))) / F.lit(1e6)


def running_total(by: Sequence[str], order: str, count: str) -> Column:
    """Cumulative count over pre-counted values, smallest first."""
    return F.sum(count).over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def percentile_columns(quantiles: dict[str, float], cum: str, total: str, bin_col: str) -> list[Column]:
    """First bin whose cumulative count reaches q * n, as a midpoint in ms."""
    return [bin_midpoint_ms(F.min(F.when(F.col(cum) >= F.lit(q) * F.col(total), F.col(bin_col))))
            .alias(name) for name, q in quantiles.items()]


def binned_percentile(df: DataFrame, by: Sequence[str], time: str,
                      quantiles: dict[str, float]) -> DataFrame:
    """Percentiles at bin resolution: the midpoint of the first bin reaching q * n."""
    counts = (df.filter(F.col(time).isNotNull())
              .groupBy(*by, delay_bin(time).alias("bin")).agg(F.count("*").alias("n")))
    return (counts.withColumn("cum", running_total(by, "bin", "n"))
            .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
            .groupBy(*by)
            .agg(*percentile_columns(quantiles, "cum", "total", "bin")))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str,
                 quantiles: dict[str, float]) -> DataFrame:
    """``sorted(values)[floor((n - 1) * p)]`` per group, for non-negative BIGINT values.

    Counts by leading digit are summed from counts by the next one, so the rows are read once. The
    wanted rank is then followed down: find the digit that holds it, continue inside. Each step is one join
    with a row per (group, quantile) and one window over at most 2**21 digits.
    """
    known = F.col(value).isNotNull()
    for col in by:
        known = known & F.col(col).isNotNull()
    levels = [df.filter(known).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))]
    for _ in _SHIFTS[1:]:
        levels.insert(0, levels[0].groupBy(*by, F.shiftright("v", _DIGIT_BITS).alias("v")).agg(F.sum("c").alias("c")))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("q"),
                 F.floor((F.col("n") - 1).cast("double") * F.lit(float(p))).cast("bigint").alias("rank"))
        for name, p in quantiles.items()])
    found = (levels[0].withColumn("upto", running_total(by, "v", "c"))
             .withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
             .withColumn("r", F.explode(ranks)).select(*by, "v", "c", "upto", "r.q", "r.rank"))
    for level in levels[1:]:
        target = _holding(found, by)
        inside = level.withColumn("prefix", F.shiftright("v", _DIGIT_BITS)).join(target, [*by, "prefix"])
        found = inside.withColumn("upto", running_total([*by, "q"], "v", "c"))
    return _holding(found, by).groupBy(*by).agg(*[
        F.max(F.when(F.col("q") == name, F.col("prefix"))).alias(name) for name in quantiles])


def _holding(running: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (group, quantile) the digits so far that hold the rank, and the rank inside them."""
    before = F.col("upto") - F.col("c")
    return (running.filter((F.col("upto") > F.col("rank")) & (before <= F.col("rank")))
            .select(*by, "q", (F.col("rank") - before).alias("rank"), F.col("v").alias("prefix")))
