"""What a stream keeps between batches: one small state file, and folders of waiting rows that the state names.

A batch reads the state of the batch before it by its path and the folders named there; nothing is found by listing, so a
batch costs the same however long the stream has run. What a batch has finished with is named in its state and
removed by the next batch, which begins only when the batch is committed; until then a replay finds all it needs.

Rows wait in two parts per batch: those up to ``AHEAD`` slots beyond the tip, and those further away, so
that a slot that cannot be real keeps no others waiting with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Slots beyond the tip that may be real soon.
AHEAD = 4096


class Part(NamedTuple):
    """A folder of waiting rows: the batch that wrote it, and its least and greatest slot."""
    batch: int
    part: str
    low: int
    high: int


class State(NamedTuple):
    tip: int | None = None
    late: int = 0
    open: tuple[Part, ...] = ()
    closed: tuple[Part, ...] = ()


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; a folder that is not there is empty."""
    files, at = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def read_note(spark: SparkSession, path: str) -> dict:
    """A small JSON file."""
    files, at = _folder(spark, path)
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_note(spark: SparkSession, folder: str, name: str, said: dict) -> None:
    """Whole or not at all: the file gets its name when it is written."""
    files, at = _folder(spark, f"{folder}/{name}")
    _, fresh = _folder(spark, f"{folder}/_{name}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(json.dumps(said).encode()))
    finally:
        stream.close()
    files.delete(at, False)
    files.rename(fresh, at)


def read_state(spark: SparkSession, store: str, batch_id: int) -> State:
    """The state after a batch; before the first one it is empty."""
    if batch_id < 0:
        return State()
    said = read_note(spark, f"{store}/state/batch={batch_id}")
    return State(said["tip"], said["late"], *(tuple(Part(*p) for p in said[name]) for name in ("open", "closed")))


def write_state(spark: SparkSession, store: str, batch_id: int, state: State) -> None:
    write_note(spark, f"{store}/state", f"batch={batch_id}", state._asdict())


def last_batch(spark: SparkSession, store: str) -> int | None:
    """The last batch that left a state. Of those no more than two are there, see ``settle``."""
    names = names_in(spark, f"{store}/state")
    return max((int(n.partition("=")[2]) for n in names if n.startswith("batch=")), default=None)


def last_state(spark: SparkSession, store: str) -> State:
    last = last_batch(spark, store)
    return State() if last is None else read_state(spark, store, last)


def settle(spark: SparkSession, store: str, batch_id: int) -> State:
    """The state that a batch starts from; what only the batches before that one needed is removed."""
    state = read_state(spark, store, batch_id - 1)
    kept = {p.batch for p in state.open}
    for part in state.closed:
        remove(spark, f"{store}/rows/batch={part.batch}" + (f"/part={part.part}" if part.batch in kept else ""))
    remove(spark, f"{store}/state/batch={batch_id - 2}")
    return state


def put(rows: DataFrame, store: str, batch_id: int, tip: int | None) -> tuple[Part, ...]:
    """Write rows that wait, by part, and name the folders."""
    near = F.lit(False) if tip is None else F.col("slot") <= tip + AHEAD
    spark, path = rows.sparkSession, f"{store}/rows/batch={batch_id}"
    # Few rows from many tasks become few files; sorted, a later reader skips what it does not close.
    (rows.withColumn("part", F.when(near, "near").otherwise("far"))
     .hint("rebalance", "part").sortWithinPartitions("part", "slot").write.mode("overwrite").partitionBy("part").parquet(path))
    ends = spark.read.schema("slot bigint, part string").parquet(path).groupBy("part").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    parts = tuple(Part(batch_id, r.part, r.low, r.high) for r in ends.orderBy("low").collect())
    if not parts:
        remove(spark, path)
    return parts


def read(spark: SparkSession, store: str, schema: StructType, parts: Iterable[Part]) -> DataFrame:
    """The rows of these folders and no others."""
    paths = [f"{store}/rows/batch={p.batch}/part={p.part}" for p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def within(slot: Column, above: int | None, upto: int) -> Column:
    return slot <= upto if above is None else (slot > above) & (slot <= upto)
