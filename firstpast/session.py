"""Session settings and the shared folder for checkpoints and working tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. All can be set on a live session.
RUNTIME_CONF = {
    # Arrival times are compared as UTC; reports bucket by UTC day.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins against a one-row-per-key side are split when one key is hot, even if
    # that costs another exchange for the aggregate above.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """What results depend on, for a session built elsewhere; its other settings stay as they are."""
    if spark.conf.get("spark.sql.session.timeZone") != RUNTIME_CONF["spark.sql.session.timeZone"]:
        spark.conf.set("spark.sql.session.timeZone", RUNTIME_CONF["spark.sql.session.timeZone"])
    return spark


def build(app: str = "firstpast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a temporary
    folder; on a cluster a missing setting is an error, because a folder of one
    machine does not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="firstpast-")
    context.setCheckpointDir(folder)
    return folder


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back.

    Used where several reports fan out from one expensive table: the lineage is
    cut at a durable file, so a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = path or working_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
