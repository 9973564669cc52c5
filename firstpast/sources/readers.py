"""Input tables and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firstpast import schema
from firstpast.operators.dims import validator_report


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A Parquet table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schema.of(table)).parquet(path)


def scan_arrivals(arrivals: DataFrame, now: dt.datetime, hours: int) -> DataFrame:
    """Rows of the last ``hours`` that have a delay.

    Both conditions reach the Parquet scan; a table partitioned by day on ``day``
    is also pruned to the days of the window.
    """
    start = now - dt.timedelta(hours=hours)
    recent = arrivals.filter((F.col("t") > F.lit(start)) & F.col("delta_ns").isNotNull())
    if "day" in arrivals.columns:
        recent = recent.filter(F.col("day").between(F.lit(start.date()), F.lit(now.date())))
    return recent


def hour_predicates(now: dt.datetime, hours: int) -> list[str]:
    """One WHERE clause per hour of the window: the parallel reads of a live database."""
    start = now - dt.timedelta(hours=hours)
    edges = [start + dt.timedelta(hours=h) for h in range(hours + 1)]
    return [f"t >= '{a.isoformat()}' AND t < '{b.isoformat()}' AND delta_ns IS NOT NULL"
            for a, b in zip(edges, edges[1:])]


def read_arrivals_jdbc(spark: SparkSession, url: str, table: str, now: dt.datetime, hours: int,
                       properties: dict[str, str]) -> DataFrame:
    """Arrivals from a live database, one task per hour (needs its JDBC driver on the classpath)."""
    return spark.read.jdbc(url, table, predicates=hour_predicates(now, hours), properties=properties)


def read_validator_report(spark: SparkSession, path: str) -> DataFrame:
    """Leader and display name from a report CSV, matched by header, with quoted fields."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if not {"leader", "name"} <= set(raw.columns):
        return spark.createDataFrame([], "leader string, name string")
    return validator_report(raw)


def read_validator_attributes(spark: SparkSession, path: str) -> DataFrame:
    """The report's attributes per validator; empty text becomes NULL, stake is read leniently."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)

    def text(col: str):
        return F.when(F.col(col) != "", F.col(col)) if col in raw.columns else F.lit(None).cast("string")

    # Positional ids keep the file's order, so the last row of a repeated key wins.
    rows = raw.withColumn("row_order", F.monotonically_increasing_id()).filter(F.coalesce("leader", F.lit("")) != "")
    attributes = F.struct(
        "row_order", text("name").alias("name"), text("client").alias("client_type"),
        text("version").alias("version"), text("data_center_key").alias("location"),
        F.floor(text("active_stake").try_cast("double")).cast("decimal(20,0)").alias("stake"))
    return (rows.groupBy(F.col("leader").alias("pubkey")).agg(F.max(attributes).alias("a"))
            .select("pubkey", "a.name", "a.client_type", "a.version", "a.location", "a.stake"))


def read_name_ip(spark: SparkSession, path: str) -> DataFrame:
    """``name|ip`` lines; the first mapping of a name wins."""
    lines = (spark.read.text(path)
             .select(F.trim("value").alias("line"),
                     F.struct("_metadata.file_path", "_metadata.file_block_start",
                              F.monotonically_increasing_id().alias("n")).alias("position"))
             .filter(F.col("line") != ""))
    pairs = lines.select(F.split_part("line", F.lit("|"), F.lit(1)).alias("name"),
                         F.split_part("line", F.lit("|"), F.lit(2)).alias("ip"), "position")
    return pairs.groupBy("name").agg(F.min_by("ip", "position").alias("ip"))


def latest_snapshot(snapshots: DataFrame, as_of: dt.date, lookback: int = 7, day: str = "day") -> DataFrame:
    """The newest daily snapshot not older than ``lookback`` days."""
    recent = snapshots.filter(F.col(day).between(F.lit(as_of - dt.timedelta(days=lookback)), F.lit(as_of)))
    return recent.filter(F.col(day) == recent.agg(F.max(day)).scalar())


def read_schedule_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed schedule responses: one JSON object per epoch with its map of leaders."""
    return spark.read.schema(schema.of("schedule_response")).json(path)


def read_gossip_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed cluster-node responses (pubkey, gossip address) as (pubkey, gossip_ip)."""
    nodes = spark.read.schema("pubkey string, gossip string").json(path)
    return (nodes.filter((F.coalesce("pubkey", F.lit("")) != "") & (F.coalesce("gossip", F.lit("")) != ""))
            .select("pubkey", F.regexp_replace("gossip", ":[^:]*$", "").alias("gossip_ip")))
