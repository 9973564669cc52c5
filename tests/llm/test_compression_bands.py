"""Measures by brute force, verdicts on clean and broken texts, odd inputs."""

import random
import re
import string
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from firstpast.llm import compression_bands as cb
from firstpast.llm.queries import QUERIES

JUDGE = cb.judge()


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    earlier = {}
    for i, line in enumerate(lines):
        earlier.setdefault(line, i)
    duplicates = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and earlier[line] < i for i, line in enumerate(lines))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated), failed


def plain_sizes(text):
    """Compressed size per character, and per byte of the text in its own alphabet."""
    order = []
    for c in text:
        if c not in order and len(order) <= 256:
            order.append(c)
    data = bytes(map(order.index, text)) if len(order) <= 256 else text.encode("utf-8")
    size = len(zstandard.compress(data, 3))
    return size / len(text), size / len(data)


def plain_kept(text):
    if brute(text)[-1]:
        return False
    per_char, ratio = plain_sizes(text)
    written = len(text) if len(set(text)) <= 256 else len(text.encode("utf-8"))
    low = [b[1] for b in cb.BANDS if len(text) >= b[0]][-1]
    high = [b[2] for b in cb.BANDS if written >= b[0]][-1]
    if per_char < low or ratio > high:
        return False
    chunks = [text[i:i + 4096] for i in range(0, len(text), 4096)]
    chunks = [(len(c), *plain_sizes(c)) for c in chunks if len(c) >= 2048]
    total = sum(c[0] for c in chunks)
    return all(2 * sum(c[0] for c in bad) <= total for bad in (
        [c for c in chunks if c[1] < cb.CHUNK_BAND[0]], [c for c in chunks if c[2] > cb.CHUNK_BAND[1]]))


@settings(max_examples=600, deadline=None)
@given(st.text("ab \n\t\x0b\x1c\x85 é🙂#|", max_size=60))
def test_measures_of_any_text(text):
    assert JUDGE(text)[:6] == brute(text)


def test_documents(spark, sf_dir, plain, labels):
    rows = {r.doc_id: r for r in QUERIES["op10_compression_bands"](spark, sf_dir).collect()}
    assert len(rows) == len(plain)
    for i, text in plain:
        assert tuple(rows[i])[1:7] == brute(text or "")
        assert rows[i].kept == plain_kept(text or "")
    clean = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect() if not rows[r.doc_id].base_failed]
    assert all(rows[i].kept for i in clean)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, weights=range(26, 0, -1), k=rng.randint(1, 9))) for _ in range(900)]
    return " ".join(rng.choices(words, weights=[1 / (k + 3) for k in range(900)], k=n))


@pytest.mark.parametrize("n", [60, 200, 1000, 5000, 40_000])
def test_prose_is_kept_and_junk_is_not(n):
    assert JUDGE(prose(n, n)).kept
    # Distinct words, so that only compression tells: a counter; noise.
    counter = " ".join(f"record-of-the-log-{i:08d}" for i in range(n))
    assert not JUDGE(counter).base_failed and not JUDGE(counter).kept
    rng = random.Random(n)
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(8)) for _ in range(n))
    assert not JUDGE(noise).kept


@pytest.mark.parametrize("first", [0x430, 0x905, 0xE01, 0x10A0, 0x10400])
def test_the_script_does_not_count(plain, first):
    other = {ord(c): chr(first + i) for i, c in enumerate(string.ascii_lowercase + string.ascii_uppercase)}
    for _, text in plain:
        latin, mapped = JUDGE(text or ""), JUDGE((text or "").translate(other))
        assert mapped.kept == latin.kept and mapped.ratio == latin.ratio


@pytest.mark.parametrize("n", [500, 5000, 40_000])
def test_scripts_of_many_characters(n):
    rng = random.Random(n)
    signs = [chr(0x4E00 + 7 * i) for i in range(2500)]
    words = ["".join(rng.choices(signs, weights=[1 / (k + 8) for k in range(2500)], k=rng.randint(1, 3))) for _ in range(4000)]
    text = " ".join(rng.choices(words, weights=[1 / (k + 3) for k in range(4000)], k=n))
    assert len(set(text)) > cb.ALPHABET
    verdict = JUDGE(text)
    assert verdict.kept and verdict.kept == plain_kept(text)
    again = text + "\n" + "".join(signs[:400]) * (len(text) // 40)
    assert not JUDGE(again).kept and not plain_kept(again)


@settings(max_examples=200, deadline=None)
@given(st.text("ab cdefgh éж🙂", min_size=1, max_size=400), st.integers(1, 60))
def test_verdicts_of_any_text(text, times):
    text = " ".join(text[i % len(text):] for i in range(times))
    assert JUDGE(text).kept == plain_kept(text)


def test_chunks_are_judged_by_themselves():
    half = prose(3, 3000)
    flat = "abcdefgh " * (len(half) // 4)
    verdict = JUDGE(half + flat)
    assert verdict.repetitive_share > 0.5 and not verdict.kept


def test_odd_inputs(tricky, nothing):
    rows = cb.measures(tricky).collect()
    assert len(rows) == tricky.count()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    kept = cb.keep(tricky)
    assert kept.columns == tricky.columns and kept.count() == sum(r.kept for r in rows)
    assert cb.measures(nothing).count() == 0 and cb.keep(nothing).count() == 0
