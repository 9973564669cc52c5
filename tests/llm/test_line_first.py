"""Kept lines by brute force, frequent lines, long texts, bitmaps, plans, odd inputs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from firstpast.llm import line_first as lf
from firstpast.llm.queries import QUERIES


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """(id, lines, dropped, kept text) of every row."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line_key(line), set()).add(i)
    first = {k: min((i for i in held if i is not None), default=None) for k, held in holders.items() if len(k) >= 10}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(line_key(x), i) == i]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def digests(rows):
    return sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)), key=repr)


def reported(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table_of(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_documents(spark, sf_dir, plain):
    assert reported(QUERIES["op11_line_first"](spark, sf_dir)) == digests(plain)


def test_odd_inputs(spark, tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert reported(lf.report(tricky)) == digests(rows)
    assert reported(lf.report(nothing)) == []
    clean = lf.without_repeats(tricky)
    assert clean.columns == tricky.columns and clean.count() == len(rows)
    assert lf.without_repeats(nothing).count() == 0 and lf.keep_bitmaps(nothing).count() == 0


LINES = ["Shared line of text", "  shared LINE of text\t", "short", "", "SHARED LINE OF TEXT\r", "ÄRGER und Mühe", "ärger und mühe",
         "Ärger UND mühe", "\x85 a line with odd ends \x85", "exactly10!", "nine char"]


def test_keys_ties_and_repeated_ids(spark):
    rows = [(5, "\n".join(LINES)), (3, "\n".join(reversed(LINES))), (3, "shared line of text\nexactly10!\nÄRGER und Mühe"),
            (None, "\n".join(LINES)), (None, "only without an id\nonly without an id"), (9, "x\n" * 5 + "exactly10!"),
            (9, "x\n" * 5 + "exactly10!"), (8, "shared line of text"), (7, "only without an ID"), (-4, None), (11, "\n\n")]
    assert reported(lf.report(table_of(spark, rows))) == digests(rows)


def test_frequent_lines_are_dealt_out(spark):
    """A line on a third of all rows, another many times in one document, and all in one text."""
    rows = [(i, f"the line that everyone has\nown line of document {i}\nown line of document {i // 2}") for i in range(3000, 0, -1)]
    rows += [(0, "often in one document\n" * 2000 + "the end of document zero"), (4000, "often in one document\nthe line that everyone has")]
    docs = table_of(spark, rows)
    assert reported(lf.report(docs)) == digests(rows)
    found = lf._frequent(lf.occurrences(docs)).count()
    assert 1 <= found <= lf.TRACKED
    plan = lf.dropped(lf.materialize(lf.occurrences(docs), "t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_one_exchange_serves_the_stream(spark):
    """The window runs on the ranges; it asks for no exchange of its own."""
    rows = lf.occurrences(table_of(spark, [(1, "a line of some length")]))
    from pyspark.sql import Window
    stream = Window.partitionBy("hash").orderBy(F.col("doc").asc_nulls_last(), "position")
    plan = rows.repartitionByRange("hash").withColumn("first", F.first("doc").over(stream))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(hash" not in plan and "rangepartitioning(hash" in plan


@pytest.mark.parametrize("lost", [[], [0], [63], [64], [0, 1, 2], [5, 64, 65, 200], list(range(300)), list(range(0, 300, 2))])
def test_bitmaps_hold_any_set(spark, lost):
    lines = [f"{i}" for i in range(300)]
    words = {}
    for p in lost:
        words[p // 64] = words.get(p // 64, 0) | 1 << p % 64
    keep = [(w, ~b if b < 1 << 63 else ~(b - (1 << 64))) for w, b in sorted(words.items())] or None
    df = spark.createDataFrame([("\n".join(lines), keep)], f"text string, keep {lf.KEEP}")
    row = df.select(lf.lost_lines(F.col("keep")).alias("lost"), lf.kept_text(F.col("text"), F.col("keep")).alias("text")).first()
    assert row.lost == lost and row.text == "\n".join(x for i, x in enumerate(lines) if i not in set(lost))


def test_long_texts_take_linear_time(spark):
    """Half of 200,000 lines go; a step that copied the text per line would not come back."""
    n = 200_000
    rows = [(1, "\n".join(f"line number {i:07d}" for i in range(0, n, 2))), (2, "\n".join(f"line number {i:07d}" for i in range(n)))]
    assert reported(lf.report(table_of(spark, rows, 2))) == digests(rows)


def test_bitmaps_are_small(spark, documents):
    rows = lf.keep_bitmaps(documents).collect()
    assert all(r.keep is None or len(r.keep) <= -(-r.n_lines // 64) for r in rows)
    assert all(r.keep != [] for r in rows) and any(r.keep for r in rows) and any(r.keep is None for r in rows)
