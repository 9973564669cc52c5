"""Pieces and places of every document, how full sequences are, the genetic operators, odd inputs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firstpast.llm import ga_packing as ga
from firstpast.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def check_places(rows, limit=1024):
    """Sequences are gapless from 0 and no longer than the limit."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(held)


def check_pieces(rows, ids, limit=1024):
    at = 0
    for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
        assert r.piece == k and r.start == at
        assert r.length == limit or (k == 0 and r.length <= limit)
        part = np.array(ids[at:at + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part)
        at += r.length
    assert at == len(ids)


def test_documents(spark, sf_dir, plain, library):
    rows = QUERIES["op8_ga_packing"](spark, sf_dir).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, _ in plain}
    for i, text in plain:
        ids = ids_of(library, text)
        assert len(by_doc[i]) == -(-len(ids) // 1024)
        check_pieces(by_doc[i], ids)
    total = sum(r.length for r in rows)
    assert check_places(rows) <= -(-total // 1024) + 2


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " " * 3000, "a" * 3000, "é漢🙂 x\n\n y", "don't  1234 !!"])
def test_same_ids_as_the_library(text, library):
    assert [*ga.encoder(PATH)(text), 2] == ids_of(library, text)


def test_operators_keep_every_piece_once():
    rng = random.Random(2)
    packer = ga.Packer([rng.randint(1, 1024) for _ in range(500)], 1024, 5)
    a, b = packer.fit([], packer.loose), packer.fit([], packer.loose[::2])
    b = packer.fit(b, packer.loose[1::2])
    for made in (packer.cross(a, b), packer.cross(b, a), packer.mutate(a), packer.evolve([a, b])):
        assert sorted(i for bin_ in made for i in bin_) == packer.loose
        assert max(map(packer.fill, made)) <= 1024
    assert sorted(map(sorted, packer.bins(packer.genome(a)))) == sorted(map(sorted, a))


def test_best_fit_takes_the_fullest_bin_that_fits():
    packer = ga.Packer([600, 500, 400, 300, 100], 1000, 0)
    assert sorted(map(sorted, packer.fit([], packer.loose))) == [[0, 2], [1, 3, 4]]


def test_evolution_beats_best_fit():
    """Pieces that fill bins exactly in threes, on which best fit alone wastes bins."""
    rng = random.Random(8)
    lengths = []
    for _ in range(60):
        a, b = rng.randint(200, 420), rng.randint(200, 420)
        lengths += [a, b, 1024 - a - b]
    rng.shuffle(lengths)
    packer = ga.Packer(lengths, 1024, 1)
    seeds = packer.seeds()
    assert packer.cost(packer.evolve(seeds)) < min(map(packer.cost, seeds))


def test_blocks_islands_and_sequences(spark, monkeypatch, library):
    monkeypatch.setattr(ga, "BLOCK", 40)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(("one", "two", "three")) for _ in range(rng.randint(0, 400)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    packed = ga.pack(df, limit=128, with_ids=True).persist()
    rows = packed.collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in docs:
        check_pieces(by_doc[i], ids_of(library, text), 128)
    count = check_places(rows, 128)
    sequences = ga.sequences(packed).collect()
    assert len(sequences) == count and max(len(s.ids) for s in sequences) <= 128
    whole = {s.sequence_id: s.ids for s in sequences}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids


def test_odd_inputs(tricky, nothing, library):
    rows = ga.pack(tricky).collect()
    check_places(rows)
    texts = [(r.doc_id, r.text) for r in tricky.collect()]
    assert sum(r.length for r in rows) == sum(len(ids_of(library, t)) for _, t in texts)
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1]
    assert sum(r.doc_id == 7 for r in rows) == 2
    assert ga.pack(nothing).count() == 0
    assert ga.pack(tricky.where(F.col("doc_id") == 5)).count() == -(-len(ids_of(library, dict(texts)[5])) // 1024)


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_sequences_do_not_follow_the_layout(spark, documents, parts):
    """However many tasks read the documents, they need the same few sequences."""
    docs = documents.select("doc_id", "text").limit(200).repartition(parts, "doc_id")
    rows = ga.pack(docs).collect()
    held = check_places(rows)
    assert held <= -(-sum(r.length for r in rows) // ga.LIMIT) + 2
    assert len({r.doc_id for r in rows}) == docs.select("doc_id").distinct().count()


def test_unfilled_blocks_are_gathered(spark):
    """Blocks of 40 tasks: none is lost, none of twice a block's size comes out, full ones stay."""
    def one(number, n):
        return (number, [number] * n, list(range(n)), [0] * n, [7] * n, [1] * n)

    sizes = [ga.BLOCK, *[(37 * k) % (ga.BLOCK - 1) + 1 for k in range(40)], ga.BLOCK]
    laid = spark.createDataFrame([one(k, n) for k, n in enumerate(sizes)], "block long, keys array<long>, pieces array<long>, "
                                 "starts array<long>, lengths array<int>, crcs array<long>").repartition(5)
    got = {r.block: r for r in ga.regrouped(laid).collect()}
    assert sum(len(r.keys) for r in got.values()) == sum(sizes) and max(len(r.keys) for r in got.values()) < 2 * ga.BLOCK
    assert len(got[0].keys) == ga.BLOCK and len(got) <= sum(sizes) // ga.BLOCK + 2
    for r in got.values():
        assert [(k, p) for k in sorted(set(r.keys)) for p in range(sizes[k])] == list(zip(r.keys, r.pieces))
