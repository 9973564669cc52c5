"""Repeated lines: the first document that holds a line keeps it, the others lose it. Built-in functions only.

Every line of ``LEAST`` code points and more gives one row of (hash of its key, document, position); texts are not moved for that.
The rows are range-partitioned by hash and sorted by document and position within a hash, so that one stream over a
partition sees the first occurrence of each hash before the later ones. What comes back is a bitmap for every
text, a bit for a line that stays: words of 64 lines, of which only those that lose a line are stored.

A hash that more than one row in ``TRACKED`` belongs to would make one range too large. Such hashes, fewer than
``TRACKED`` of them, are found by a frequent-items sketch and dealt out to ``PARTS`` ranges each. The first occurrences of the
parts are then compared among each other.

Defined cases: NULL and empty texts have one empty line, which is too short to be dropped; rows that share an id are one
document, whose lines do not drop each other; a NULL id is one document, after all others; equal rows get equal results; an empty
table gives no rows. A document that holds a line twice and is its first keeps both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.llm.common import unused
from firstpast.session import materialize

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST = 10
# Items of the sketch; a hash not among them holds no larger part of the rows than one in this many.
TRACKED = 1024
PARTS = 1024
WORD = 64
KEEP = "array<struct<word:int,bits:bigint>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_digest(key: Column, text: Column) -> Column:
    """What is the same for rows of one id and one text, NULL ids included."""
    one = F.coalesce(F.md5(key.cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(one, F.lit(":"), F.coalesce(text, F.lit("")))))


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``(hash, doc, row, position)`` of every line that is long enough."""
    said = F.col(text)
    # The digest is made before the lines are set apart, or every line would make it again.
    made = docs.select(F.col(key).alias("doc"), row_digest(F.col(key), said).alias("row"),
                       split_lines(lower_ascii(said)).alias("lines"))
    each = made.select("doc", "row", F.posexplode("lines").alias("position", "line"))
    return (each.select("doc", "row", "position", F.trim("line", F.lit(SPACES)).alias("line"))
            .where(F.char_length("line") >= least)
            .select(F.unhex(F.md5("line")).alias("hash"), "doc", "row", "position"))


def _frequent(rows: DataFrame) -> DataFrame:
    """At most ``TRACKED`` short hashes, those of which more than one row in ``TRACKED`` may be."""
    sketch = rows.agg(F.expr(f"approx_top_k(xxhash64(hash), {TRACKED}, {32 * TRACKED})").alias("top"), F.count("*").alias("n"))
    return (sketch.select("n", F.explode("top").alias("top")).where(F.col("top.count") * TRACKED > F.col("n"))
            .select(F.col("top.item").alias("short")))


def _later(doc: str, first: str) -> Column:
    return ~F.col(doc).eqNullSafe(F.col(first))


def dropped(rows: DataFrame) -> DataFrame:
    """``(row, position)`` of the occurrences outside the first document of their hash."""
    # At most TRACKED rows, so they may go to every task.
    frequent = F.broadcast(_frequent(rows).withColumn("split", F.lit(True)))
    dealt = (rows.withColumn("short", F.xxhash64("hash")).join(frequent, "short", "left")
             .withColumn("part", F.when(F.col("split"), F.floor(F.rand(11) * PARTS)).otherwise(0).cast("int")))
    ranges = dealt.repartitionByRange("hash", "part")
    stream = Window.partitionBy("hash", "part").orderBy(F.col("doc").asc_nulls_last(), "position")
    first = F.first("doc").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The partitioning by range serves the window as it is: one exchange, one sort.
    seen = ranges.withColumn("first", first).withColumn("later", _later("doc", "first"))
    kept = materialize(
        seen.where(F.col("later") | F.col("split"))
        .select(F.when(~F.col("later"), F.col("hash")).alias("hash"), "doc", "row", "position", "later"), "line-stream")
    # First occurrences of the parts of a frequent hash; again at most TRACKED rows once reduced.
    open_ = kept.where(~F.col("later"))
    firsts = open_.groupBy("hash").agg(F.min("doc").alias("first"))
    settled = open_.join(F.broadcast(firsts), "hash").where(_later("doc", "first"))
    return kept.where("later").select("row", "position").union(settled.select("row", "position"))


def bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``(row, keep)`` of the texts that lose a line."""
    rows = materialize(occurrences(docs, text, key, least), "line-hashes")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("position") % WORD)
    words = (dropped(rows).groupBy("row", F.floor(F.col("position") / WORD).cast("int").alias("word"))
             .agg(F.bit_or(bit).alias("lost")))
    return words.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).cast(KEEP).alias("keep"))


def lost_lines(keep: Column) -> Column:
    """Positions whose bit is not set, in order."""
    numbers = F.sequence(F.lit(0), F.lit(WORD - 1))
    places = F.transform(keep, lambda w: F.transform(
        F.filter(numbers, lambda b: F.getbit(w["bits"], b) == 0), lambda b: w["word"] * WORD + b))
    return F.coalesce(F.flatten(places), F.array().cast("array<int>"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined; each run between two lost lines is copied once."""
    def joined(lines: Column) -> Column:
        def between(lost: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), lost)
            after = F.concat(lost, F.array(F.size(lines)))
            runs = F.arrays_zip(before.alias("a"), after.alias("b"))
            return F.flatten(F.transform(runs, lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1)))

        return F.array_join(let(lost_lines(keep), between), "\n")

    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(split_lines(text), joined))


def _with_bitmaps(docs: DataFrame, text: str, key: str, least: int) -> tuple[DataFrame, str, str]:
    row, keep = unused(docs, "row_of_text"), unused(docs, "keep_of_text")
    found = materialize(bitmaps(docs, text, key, least), "line-bitmaps").toDF(row, keep)
    return docs.withColumn(row, row_digest(F.col(key), F.col(text))).join(found, row, "left"), row, keep


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Of every row its id, its number of lines and ``keep``; NULL where all lines stay."""
    both, _, keep = _with_bitmaps(docs, text, key, least)
    return both.select(key, F.size(split_lines(F.col(text))).cast("long").alias("n_lines"), F.col(keep).alias("keep"))


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """The rows with all their columns, without the lines that an earlier document holds."""
    both, _, keep = _with_bitmaps(docs, text, key, least)
    return both.select(*[
        F.when(F.col(keep).isNull(), F.col(text)).otherwise(kept_text(F.col(text), F.col(keep))).alias(c) if c == text
        else F.col(c) for c in docs.columns])


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Counts of lines and a digest of what stays, of every row."""
    both, _, keep = _with_bitmaps(docs, text, key, least)
    lost = F.aggregate(F.col(keep), F.lit(0).cast("bigint"), lambda n, w: n + WORD - F.bit_count(w["bits"]))
    return both.select(
        key, F.size(split_lines(F.col(text))).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0).cast("bigint")).alias("n_dropped"),
        F.sha2(kept_text(F.col(text), F.col(keep)), 256).alias("kept_sha256"))


def check_sql(least: int = LEAST) -> str:
    """DuckDB SQL for ``report`` over the table ``documents``."""
    spaces = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM d),
k AS (SELECT n, doc_id, line, place, translate(trim(line, {spaces}), '{UPPER}', '{UPPER.lower()}') AS line_key FROM e),
f AS (SELECT line_key, min(doc_id) AS first FROM k WHERE length(line_key) >= {least} GROUP BY line_key),
j AS (SELECT n, line, place, first IS NOT NULL AND doc_id IS DISTINCT FROM first AS lost
      FROM k LEFT JOIN f ON k.line_key = f.line_key AND length(k.line_key) >= {least}),
s AS (SELECT n, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
             string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost) AS kept FROM j GROUP BY n)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN s USING (n)"""
