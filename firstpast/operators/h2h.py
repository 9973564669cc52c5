"""Head-to-head comparison of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.functions.numeric import percent
from firstpast.operators.race import HUB_RACE


def finishing_orders(ranked: DataFrame, key: Sequence[str] = HUB_RACE) -> DataFrame:
    """The order of sources in every race; a race has at most one entry per source, so it is a short array."""
    return (ranked.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("finish"))
            .select("hub", F.col("finish.source").alias("finish")))


def head_to_head(ranked: DataFrame, key: Sequence[str] = HUB_RACE) -> DataFrame:
    """For each ordered pair: races a led b, races both delivered, and the share.

    Pairs in which a never led are absent.
    """
    return (_pairs(ranked, key)
            .select("hub", F.explode(F.array(_side("a", "b"), _side("b", "a"))).alias("p"))
            .select("hub", "p.*").filter(F.col("a_first_count") > 0)
            .withColumn("a_first_pct", percent("a_first_count", "both_present")))


def _pairs(ranked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Unordered pairs (a < b) with the races either side led.

    Pairs are formed where a race's order is, and counted there first: a task sends a row per
    hub and pair, however many races it has.
    """
    ordered = F.col("first") < F.col("second")
    return (finishing_orders(ranked, key)
            .select("hub", "finish", F.posexplode("finish").alias("i", "first"))
            .select("hub", "first", F.explode(F.expr("slice(finish, i + 2, size(finish))")).alias("second"))
            .groupBy("hub", F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))
            .agg(F.count_if(ordered).alias("led_by_a"), F.count_if(~ordered).alias("led_by_b")))


def _side(one: str, other: str) -> Column:
    return F.struct(F.col(one).alias("source_a"), F.col(other).alias("source_b"),
                    (F.col("led_by_a") + F.col("led_by_b")).alias("both_present"),
                    F.col(f"led_by_{one}").alias("a_first_count"))


def h2h_matrix_long(h2h: DataFrame) -> DataFrame:
    """Both triangles of "row beats column %"; >= 60 is good, <= 40 bad."""
    behind = F.col("both_present") - F.col("a_first_count")
    cell = F.explode(F.array(
        F.struct(F.col("source_a").alias("row_source"), F.col("source_b").alias("col_source"),
                 F.col("a_first_pct").alias("beats_pct")),
        F.struct(F.col("source_b").alias("row_source"), F.col("source_a").alias("col_source"),
                 percent(behind, F.col("both_present")).alias("beats_pct"))))
    # A pair in which either side led at some time appears twice, with equal values.
    cells = (h2h.select("hub", cell.alias("cell")).select("hub", "cell.*")
             .groupBy("hub", "row_source", "col_source").agg(F.max("beats_pct").alias("beats_pct")))
    band = (F.when(F.col("beats_pct") >= 60, "good").when(F.col("beats_pct") <= 40, "bad")
            .otherwise("even"))
    return cells.withColumn("band", band)


def h2h_matrix(matrix_long: DataFrame, sources: Sequence[str]) -> DataFrame:
    """The matrix as a table: one row per source, best mean first, one column per named opponent."""
    mean = F.avg("beats_pct").over(Window.partitionBy("hub", "row_source"))
    return (matrix_long.withColumn("mean_beats_pct", mean)
            .groupBy("hub", "row_source", "mean_beats_pct")
            .pivot("col_source", list(sources)).agg(F.round(F.first("beats_pct"), 1))
            .orderBy("hub", F.desc("mean_beats_pct"), "row_source"))
