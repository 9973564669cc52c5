"""Ids and decoded texts against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firstpast.llm import backtrack_bpe as bpe
from firstpast.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(bpe.vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


CODEC = bpe.codec(bpe.vocabulary_path())


def test_all_documents(spark, sf_dir, plain, library):
    rows = {r.doc_id: r for r in QUERIES["op3_backtrack_bpe"](spark, sf_dir).collect()}
    assert len(rows) == len(plain)
    for i, text in plain:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60) | st.text("abet hin's<|>1é́", max_size=40))
def test_any_text(text):
    made = Tokenizer.from_file(bpe.vocabulary_path()) if not hasattr(test_any_text, "made") else test_any_text.made
    test_any_text.made = made
    ids = made.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == made.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "the" * 2000, "é" * 3000, "!" * 3000])
def test_long_words(word, library):
    assert CODEC.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_later_scripts_and_special_strings(library):
    for text in ("漢字 テキスト", "շ՘", "a<|endoftext|>b<|startoftext|><|endoftext|>", "Σας ΣΑΣ", "İstanbul", "x\x85y\x1cz"):
        assert CODEC.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_odd_inputs(tricky, nothing, library):
    rows = {(r.doc_id, len(r.ids)) for r in bpe.encoded(tricky).collect()}
    want = {(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in tricky.collect()}
    assert rows == want
    assert bpe.digests(nothing).count() == 0
    assert CODEC.decode([]) == ""
