"""Alignment by brute force, the composition's laws, long documents over many tasks, odd inputs."""

import hashlib
import random
from collections import Counter
from functools import reduce

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firstpast.llm import fragment_align as fa
from firstpast.llm.queries import QUERIES

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = fa.byte_level(PATH_A), fa.pieces(PATH_B)
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def bytes_of_a(library):
    """Bytes of the library's entries: visible stand-ins back to bytes."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    return lambda i: bytes(table[c] for c in library.id_to_token(i))


def groups_of(text, libraries):
    """[(ids of A, ids of B)] of one text, an offset at a time."""
    a, b = libraries
    data = (" " + (text or "")).encode()
    token = bytes_of_a(a)
    ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
    ids_b = b.encode(text or "")
    bytes_a = [token(i) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i in ids_b for p in [b.id_to_piece(i)]]
    if not text or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return []
    groups, ga, gb, at_a, at_b, k = [], [], [], 0, 0, 0
    for i, x in zip(ids_a, bytes_a):
        ga.append(i)
        at_a += len(x)
        while at_b < at_a:
            gb.append(ids_b[k])
            at_b += len(bytes_b[k])
            k += 1
        if at_a == at_b:
            groups.append((ga, gb))
            ga, gb = [], []
    return groups


def brute(rows, libraries):
    every = [(i, groups_of(t, libraries)) for i, t in rows]
    links = [[(ga[-1], gb[-1]) for ga, gb in groups] for _, groups in every]
    counts = Counter(p for some in links for p in some)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for (i, groups), some in zip(every, links):
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        yield (i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(some),
               sum(counts[p] == best[p[1]] for p in some), sum(counts[p] for p in some),
               hashlib.sha256(said.encode()).hexdigest() if groups else "")


def reported(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def held_against(df, rows, libraries):
    assert reported(df) == sorted(brute(rows, libraries), key=repr)


def test_documents(spark, sf_dir, plain, libraries):
    held_against(QUERIES["op12_fragment_align"](spark, sf_dir), plain, libraries)


def test_odd_inputs(tricky, nothing, libraries):
    held_against(fa.report(tricky), [(r.doc_id, r.text) for r in tricky.collect()], libraries)
    assert fa.report(nothing).columns == list(COLUMNS) and fa.report(nothing).count() == 0


# No place for a cut; a mark that is not given back; words of every kind.
LONG = ["漢字" * 900, "x" * 3000, "word " * 700, "  two  spaces\n\n" * 200, "ends in a space " * 90, "12 34 ab cd " * 150 + "▁",
        "naïve café – “quoted” 🙂 text; " * 60, "a" * 200 + " b" * 200 + "é" * 200, "<|endoftext|> </s> <s> <unk> <0x0A> " * 60]


@pytest.mark.parametrize("size, fan", [(7, 2), (64, 3), (500, 16)])
def test_long_documents_over_many_ranges(spark, libraries, size, fan):
    rng = random.Random(size)
    rows = [(k % 7 if k % 5 else None, t) for k, t in enumerate(LONG + LONG[:3])]
    rows += [(100 + k, "".join(rng.choice("ab é漢 \n.'s9") for _ in range(900))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held_against(fa.report(docs, size=size, fan=fan), rows, libraries)


def test_segments_are_encoded_as_in_the_whole(plain):
    for _, text in plain[:60]:
        parts = list(fa.segments(text or "", 40))
        assert " ".join(parts) == (text or "")
        for tokens in (A, B):
            assert [i for p in parts for i in tokens.encode(p)] == list(tokens.encode(text or "")) or not text


texts = st.text("ab é漢\n.'s9", min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts, st.lists(st.integers(1, 40), max_size=6), st.randoms())
def test_composition_is_associative(text, cuts, rng):
    """Any bracketing of any byte ranges gives the whole text's fragment and closes the same groups."""
    tokens, writer = fa.stream(text, A, B), fa.Writer(A, B)
    total = len(text.encode()) + 1
    edges = sorted({0, total, *(c % total for c in cuts)})
    parts = [fa.fragment(tokens, low, high, low, writer) for low, high in zip(edges, edges[1:])]
    texts_of = [[(f.at, 0, c.text)] if c.text else [] for f, c in parts]
    row = [(f, t) for (f, _), t in zip(parts, texts_of)]
    while len(row) > 1:
        k = rng.randrange(len(row) - 1)
        (x, tx), (y, ty) = row[k:k + 2]
        both, made = fa.compose(x, y)
        row[k:k + 2] = [(both, tx + ([(y.at, -1, writer.group(made).text)] if made else []) + ty)]
    got, closed = row[0]
    want, inner = fa.fragment(tokens, 0, total, 0, writer)
    assert got._replace(at=0) == want._replace(at=0)
    assert ";".join(t for _, _, t in sorted(closed)) == inner.text
    identity = [fa.compose(fa.EMPTY, got)[0], fa.compose(got, fa.EMPTY)[0]]
    assert identity == [got, got]
    assert reduce(lambda x, y: fa.compose(x, y)[0], [f for f, _ in parts], fa.EMPTY) == got


def test_pairs_are_bounded_by_the_vocabularies(spark, documents):
    bound = fa.pair_bound(A, B)
    found = fa.pair_counts(fa.align(documents.select("doc_id", "text")).links)
    assert 0 < found.count() < bound < 1_000_000
    for code, _ in found.limit(2000).collect():
        x, y = A.of_id[code // len(B.of_id)], B.of_id[code % len(B.of_id)]
        assert x.endswith(y) or y.endswith(x)
