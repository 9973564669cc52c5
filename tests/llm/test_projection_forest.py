"""Recall against brute force, exact scores, ties, odd vectors, hot vectors."""

import numpy as np
from pyspark.sql import functions as F

from firstpast.llm import projection_forest as pf
from firstpast.llm.queries import QUERIES


def brute(rows, nearest=5):
    ids = np.array([i for i, _ in rows])
    all_of = np.array([v for _, v in rows], np.float64)
    norms = np.linalg.norm(all_of, axis=1)
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            v = np.array(v, np.float64)
            score = (all_of * v).sum(1) / (norms * np.linalg.norm(v))
            score[ids == i] = -2
            order = np.lexsort((ids, -np.round(score, 12)))
            out[i] = [(int(ids[k]), score[k]) for k in order[:nearest] if score[k] > -2]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), by_query(QUERIES["op2_projection_forest"](spark, sf).collect())
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, found in got.items():
        assert len(found) == 5 and q not in [i for i, _ in found]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            a, b = np.array(vectors[q], np.float64), np.array(vectors[i], np.float64)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_one_vector_is_a_third_of_all(spark):
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(8).round(3).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.standard_normal(8).round(3).tolist()) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(pf.nearest(vectors, F.col("vec_id") % 50 == 0).collect())
    want = brute(rows)
    for q in want:
        if q % 3 == 0:  # copies tie, the smallest ids win
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert len({s for _, s in got[q]}) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]),
            (50, [1.0, 1.0]), (100, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = by_query(pf.nearest(vectors, F.col("vec_id") % 50 == 0).collect())
    assert {q: [i for i, _ in found] for q, found in got.items()} == {0: [1, 50, 2], 50: [0, 1, 2]}
    assert pf.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert pf.nearest(vectors.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_levels_below_the_sample(monkeypatch, spark):
    """Trees that go on below their sample lose no vector, and opening all leaves is exact."""
    monkeypatch.setattr(pf, "SAMPLE", 100)
    monkeypatch.setattr(pf, "LEAF_ROWS", 8)
    monkeypatch.setattr(pf, "CELL", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(pf.fit(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 400)[0].further) > 1
    got = by_query(pf.nearest(vectors, F.col("vec_id") % 50 == 0, leaves=100_000).collect())
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in brute(rows).items()}


def test_short_queries_open_more_leaves(spark, monkeypatch):
    monkeypatch.setattr(pf, "SAMPLE_LEAF", 2)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(pf.nearest(vectors, F.col("vec_id") % 50 == 0, leaves=1).collect())
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        assert len({i for i, _ in found} - {q}) == 5
    # With fewer candidates than asked for, all of them are found, in order.
    few = vectors.where("vec_id IN (0, 7, 50, 211)")
    got = by_query(pf.nearest(few, F.col("vec_id") % 50 == 0, leaves=1).collect())
    want = brute([r for r in rows if r[0] in (0, 7, 50, 211)])
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
