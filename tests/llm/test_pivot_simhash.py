"""Fingerprints and components against all pairs, dense groups, odd inputs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from firstpast.llm import pivot_simhash as ps
from firstpast.llm.queries import QUERIES


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """(id, print) rows to the smallest id that links reach, by all pairs."""
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    lowest = {}
    for i, p in rows:
        if i is not None:
            lowest[find(p)] = min(i, lowest.get(find(p), i))
    return {(i, p): lowest.get(find(p)) for i, p in rows}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_documents(spark, sf_dir, plain):
    rows = QUERIES["op7_pivot_simhash"](spark, sf_dir).collect()
    assert len(rows) == len(plain)
    prints = [(i, slow_print(t)) for i, t in plain]
    want = slow_components(prints)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in rows} == want
    assert all(len(r.fingerprint) == 16 for r in rows)


def crowd(seed=3, n=700):
    """Scattered fingerprints, chains of links, and a dense group."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(n)]
    chain = rng.getrandbits(64)
    for _ in range(60):
        for _ in range(rng.randint(1, 4)):
            chain ^= 1 << rng.randrange(64)
        prints.append(chain)
    centre = rng.getrandbits(64)
    for _ in range(n):
        p = centre
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    rng.shuffle(prints)
    return list(enumerate(prints))


@pytest.mark.parametrize("bucket", [ps.BUCKET, 8])
def test_crowds_by_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(ps, "BUCKET", bucket)  # the smaller one splits hot buckets again
    rows = crowd()
    prints = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, print long")
    got = {r["print"]: r.component_id for r in ps.classes(prints).collect()}
    assert {(i, p): got[signed(p)] for i, p in rows} == slow_components(rows)


def test_every_link_shares_a_bucket():
    rng = random.Random(1)
    for masks, free in [(ps.MASKS, (1 << 64) - 1), *zip(ps.SUB_MASKS, [~m for m in ps.MASKS])]:
        positions = [b for b in range(64) if free >> b & 1]
        for _ in range(50):
            difference = sum(1 << b for b in rng.sample(positions, 3))
            assert any(not difference & m for m in masks)


def test_pivots_discard_no_link():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, 400, np.uint64)
    prints[200:] = prints[:200] ^ np.uint64(0b1011)
    root = ps.linked(prints, np.array([400]))
    assert (root[200:] == root[:200]).all() and len(set(root.tolist())) == 200


def test_long_text_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(30_000))
    assert ps.fingerprint(text) == ps.fingerprint(text, 100) == signed(slow_print(text))


def test_stage_keeps_one_of_each(spark, documents):
    kept = ps.first_of_each(documents)
    found = {r.doc_id: r.component_id for r in ps.near_duplicates(documents).collect()}
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_odd_inputs(tricky, nothing):
    rows = ps.near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16 and by_id[3].component_id == 2
    assert by_id[8].component_id == 7
    kept = ps.first_of_each(tricky)
    assert kept.columns == tricky.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in rows} - {None})
    assert ids.count(7) == 1 and ids.count(None) == (by_id[None].component_id is None)
    assert ps.near_duplicates(nothing).count() == 0 and ps.first_of_each(nothing).count() == 0


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h == signed(xxhash.xxh64_intdigest(b"a b c", 42))


def test_stage_keeps_each_component_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{w}{k}x{j}" for j in range(40)) for k, w in enumerate(("ash", "beech", "cedar", "elm", "fir"))]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (None, texts[3]), (2, texts[3]),
            (None, texts[4]), (5, texts[4]), (1, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r.text, r.doc_id) for r in ps.first_of_each(docs).collect()))
    assert kept == sorted(zip(texts, (None, None, 1, 1, 5)))
