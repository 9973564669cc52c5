"""Streaming sources and sinks.

Batches are written to a directory of their own and overwritten on replay, so a
restarted query leaves each batch exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from firstpast.streaming.waiting import names_in, read_note, remove, write_note

BatchFunction = Callable[[DataFrame, int], None]


def read_landed(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A landing directory of Parquet files as a stream, oldest file first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def write_batch(df: DataFrame, path: str, batch_id: int) -> int:
    """Write one micro-batch and return how many rows were written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return seen.get["rows"]


def table_sink(path: str, name: str, counts: str | None = None) -> BatchFunction:
    """A batch function that appends to a table; ``counts``: a folder in which rows written and failed attempts are counted.

    The counts are files, so they outlive the session. A batch's file holds the totals up to it, so a batch that is
    done again does not count twice; every failed attempt leaves a file, which the batch folds in when it succeeds.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = counts and f"{counts}/{name}"
        try:
            rows = write_batch(batch, path, batch_id)
        except Exception:
            if folder:
                write_note(spark, folder, f"failed-{batch_id}-{uuid.uuid4().hex}", {})
            raise
        if not folder:
            return
        names = names_in(spark, folder)
        before = read_note(spark, f"{folder}/batch={batch_id - 1}") if f"batch={batch_id - 1}" in names else {"rows": 0, "failed": 0}
        failed = [n for n in names if n.startswith(f"failed-{batch_id}-")]
        # A batch done again may have folded its failures in already.
        folded = read_note(spark, f"{folder}/batch={batch_id}")["own"] if f"batch={batch_id}" in names else 0
        write_note(spark, folder, f"batch={batch_id}", {
            "rows": before["rows"] + rows, "failed": before["failed"] + folded + len(failed), "own": folded + len(failed)})
        for done in [*failed, f"batch={batch_id - 2}"]:
            remove(spark, f"{folder}/{done}")

    return write


def written_counts(spark: SparkSession, counts: str, name: str) -> tuple[int, int]:
    """Rows written to a table and attempts that failed, over all sessions."""
    folder = f"{counts}/{name}"
    names = names_in(spark, folder)
    last = max((n for n in names if n.startswith("batch=")), key=lambda n: int(n.partition("=")[2]), default=None)
    said = read_note(spark, f"{folder}/{last}") if last else {"rows": 0, "failed": 0}
    return said["rows"], said["failed"] + sum(n.startswith("failed-") for n in names)


def start(stream: DataFrame, write: BatchFunction, checkpoint: str, every: str | None = None,
          output_mode: str = "append") -> StreamingQuery:
    """Start a query that hands closed rows to ``write``.

    ``every`` is a processing-time interval; without it the query works off what
    is there and stops.
    """
    writer = stream.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def rotated_sink(path: str, rotate_secs: int, rx_ns: str = "first_ns") -> BatchFunction:
    """A batch function that files rows under the output window they fall into."""
    from firstpast.sources.writers import write_rotated

    def write(batch: DataFrame, batch_id: int) -> None:
        write_rotated(batch, f"{path}/batch={batch_id}", rotate_secs, rx_ns, mode="overwrite")

    return write
