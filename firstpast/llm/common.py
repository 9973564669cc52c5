"""What the operators share: batches in bounded slices, integer folds, linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from firstpast.session import materialize

# Rows handled at once inside a task: texts may be long, so few of them are Python objects at a time.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the documents; whatever else the table holds is not read."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str, parts: int) -> Column:
    """``crc32`` of the value as text, modulo ``parts``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def hashed_sample(df: DataFrame, rows: int, *keys: str, of: int | None = None) -> DataFrame:
    """About ``rows`` rows, twice as many at most, those whose keys hash lowest; ``of``: how many rows ``df`` has."""
    of = df.count() if of is None else of
    wide = 1 << 40
    share = wide if of <= rows else int(wide * rows / of)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(wide)) < share).limit(2 * rows)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a Spark DDL text, made on the driver for use inside tasks."""
    return to_arrow_schema(StructType.fromDDL(schema))


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[str], tuple]], text: str = "text",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row and the columns that ``make()(text)`` returns for its text.

    ``make`` runs once per task and returns the function of one text (NULL is
    the empty text). ``schema`` describes the kept columns followed by the new ones.
    """
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches):
            made = zip(*(function(t or "") for t in batch.column(len(keep)).to_pylist()))
            columns = [batch.column(i) for i in range(len(keep))] + [list(c) for c in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, fields)],
                schema=fields)

    return df.select(*keep, text).mapInArrow(task, schema)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[str], bool]], text: str = "text") -> DataFrame:
    """The rows whose text the function accepts, with all their columns, without moving a row."""
    at = df.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches):
            yield batch.filter(pa.array([function(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(task, df.schema)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; root is the smallest node reachable.

    Alternates two joins over the links, each written to the shared folder: every
    node's larger neighbours are linked to the smallest neighbour, then its
    smaller ones. The links become stars after a number of rounds that grows with
    the logarithm of a component's size. Joins are between written tables, so a
    hub with very many links is split by the adaptive skew join.
    """
    links = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        f"{name}-links")
    for _ in range(rounds):
        before = links
        both = before.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(before.select("lo", "hi"))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}-least")
        # Every larger neighbour v of u, linked to the smallest neighbour of u; u itself is linked to it as well.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        own = least.where("m < u").select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.union(own).distinct(), f"{name}-large")
        down = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), f"{name}-down")
        small = large.select(F.col("hi").alias("u"), "lo").join(down, "u")
        links = materialize(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(down.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), f"{name}-links")
        # Stars: no node is both an end and a centre, and each end has one centre.
        ends = links.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("k"))
        chained = links.select(F.col("lo").alias("hi")).distinct().join(links.select("hi").distinct(), "hi").limit(1)
        n, k = ends.first()
        if n == k and not chained.take(1):
            break
    else:
        raise RuntimeError("the links did not settle")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        links.select("lo", "lo").distinct())
