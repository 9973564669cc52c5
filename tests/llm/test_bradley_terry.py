"""Held-out quality, folds, odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from firstpast.llm import bradley_terry as bt
from firstpast.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_labels_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op1_bradley_terry"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(r.score, r.predicted, r.quality) for r in rows.where("held_out").join(labels, "doc_id").collect()]
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.95
    kept, dropped = (np.mean([p for _, p, q in held if q == k]) for k in (1, 0))
    assert kept > 0.95 and dropped < 0.35


def test_folds_and_decisions(spark, documents, labels):
    for r in bt.scored(documents, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_held_out_labels_change_nothing(documents, labels):
    flipped = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = bt.fit(documents, labels), bt.fit(documents, flipped)
    assert np.array_equal(a.weights, b.weights) and a.border == b.border


def test_other_columns_are_no_inputs(documents, labels):
    model = bt.fit(documents, labels)
    other = documents.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("other"))
    one = {r.doc_id: r.score for r in bt.scored(documents, labels, model=model).collect()}
    assert one == {r.doc_id: r.score for r in bt.scored(other, labels, model=model).collect()}


def test_odd_inputs(spark, tricky, nothing, documents, labels):
    model = bt.fit(documents, labels)
    rows = bt.scored(tricky, labels, model=model).collect()
    assert len(rows) == tricky.count()
    by_text = {r.doc_id: r.score for r in rows}
    assert by_text[2] == by_text[3]
    kept = bt.keep(tricky, labels, model=model)
    assert kept.columns == tricky.columns and kept.count() == sum(r.predicted for r in rows)
    assert bt.scored(nothing, labels, model=model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 0), (7, 1), (7, 1), (8, 5)], "doc_id long, quality int")
    assert [r.score for r in bt.scored(tricky, odd).collect()] == [0.5] * len(rows)


def test_preferences_by_brute_force():
    """A feature that every preferred text has more of gets a positive weight, others next to none."""
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((400, len(bt.NAMES)))
    labels = (rows[:, 3] + 0.3 * rng.standard_normal(400) > 0).astype(float)
    model = bt.learn(rows, labels)
    assert model.weights[3] > 3 * np.abs(np.delete(model.weights, 3)).max()
    predicted = np.array([model.score(r.tolist()) >= bt.ACCEPTED for r in rows])
    assert (predicted == (labels == 1)).mean() > 0.85


def test_a_repeated_id_does_not_push_a_label_out(spark, documents, labels):
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    few = [[r.doc_id for r in known.where(F.col("quality") == k).orderBy("doc_id").limit(30).collect()] for k in (0, 1)]
    some = known.where(F.col("doc_id").isin(few[0] + few[1]))
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isin(few[0] + few[1]))
    hot = spark.range(400).select(F.lit(few[0][0]).alias("doc_id"), F.concat(F.lit("# $ buy now "), "id").alias("text"))
    model = bt.fit(docs.union(hot), some, per_label=40)  # the hot id alone has more rows than 8 * 40
    assert model.weights.any()
    assert np.array_equal(bt.fit(docs.union(docs), some, per_label=40).weights, bt.fit(docs, some, per_label=40).weights)
    predicted = {r.doc_id: r.predicted for r in bt.scored(docs, some, model=model).collect()}
    kept = [np.mean([predicted[i] for i in few[k] if i in predicted]) for k in (0, 1)]
    assert kept[0] < 0.35 and kept[1] > 0.8
