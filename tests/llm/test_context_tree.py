"""Base scores and model scores against a slow context tree, folds, odd inputs."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from firstpast.llm import context_tree as ct
from firstpast.llm.queries import QUERIES


class SlowTree:
    """Context-tree weighting as it is defined, with dictionaries and recursion."""

    def __init__(self, texts):
        self.count = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for text in texts:
            for context, byte in self.steps(text):
                for depth in range(ct.DEPTH + 1):
                    if depth:
                        self.below[context[:depth - 1]].add(context[:depth])
                    for level in range(8):
                        node = 1 << level | byte >> (8 - level)
                        self.count[context[:depth], node][byte >> (7 - level) & 1] += 1
        self.known = {}

    @staticmethod
    def steps(text):
        padded = bytes(ct.DEPTH) + text.encode().lower() + b"\0"
        for i in range(ct.DEPTH, len(padded)):
            yield padded[i - ct.DEPTH:i][::-1], padded[i]

    def kt(self, context, node):
        a, b = self.count.get((context, node), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def logs(self, context, node):
        """(own, extensions', weighted)"""
        if (context, node) not in self.known:
            own = self.kt(context, node)
            if len(context) == ct.DEPTH:
                self.known[context, node] = own, None, own
            else:
                longer = sum(self.logs(c, node)[2] for c in self.below[context] if (c, node) in self.count)
                high = max(own, longer)
                self.known[context, node] = own, longer, high + math.log(
                    math.exp(own - high) + math.exp(longer - high)) - math.log(2)
        return self.known[context, node]

    def probability(self, context, node, bit, depth=0):
        at = context[:depth]
        counts = self.count.get((at, node), (0, 0))
        own = (counts[bit] + .5) / (sum(counts) + 1)
        if depth == ct.DEPTH or (context[:depth + 1], node) not in self.count:
            return own
        mine, longer, _ = self.logs(at, node)
        weight = 1 / (1 + math.exp(min(700, longer - mine)))
        return weight * own + (1 - weight) * self.probability(context, node, bit, depth + 1)

    def score(self, text):
        return sum(math.log10(self.probability(c, 1 << level | b >> (8 - level), b >> (7 - level) & 1))
                   for c, b in self.steps(text) for level in range(8))


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def words(text):
    return [*(text or "").encode().lower().split(), None]


def base(docs):
    count = Counter(w for i, t in docs if not held(i) for w in words(t))
    total, distinct = sum(count.values()), len(count)
    return total, {(i, t): (len(words(t)), sum(count[w] > 0 for w in words(t)),
                            sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words(t))) for i, t in docs}


SMALL = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "The Cat sat", "a dog, a cat", "", None, "ünder the mät", "the the the the", "zzz 0x1f"] * 3)]


def check(rows, docs, tolerance=1e-4):
    total, want = base(docs)
    tree = SlowTree([t or "" for i, t in docs if not held(i)])
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id) and r.train_tokens == total
        found = [(r.n_tokens, r.n_known) == want[r.doc_id, t][:2] and math.isclose(r.base_score, want[r.doc_id, t][2], rel_tol=1e-9)
                 and math.isclose(r.score, tree.score(t or ""), rel_tol=tolerance) for t in texts[r.doc_id]]
        assert any(found), (r, [tree.score(t or "") for t in texts[r.doc_id]])


def test_small_corpus_by_brute_force(spark):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string").repartition(3)
    check(ct.scores(docs).collect(), SMALL)


def test_many_chunks_agree_with_one(spark, monkeypatch):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string").coalesce(1)
    one = {r.doc_id: r for r in ct.scores(docs).collect()}
    monkeypatch.setattr(ct, "CHUNK", 40)
    assert len(ct.chunks(docs, "text", "doc_id").collect()) > 3
    for r in ct.scores(docs).collect():
        assert r[:6] == one[r.doc_id][:6] and math.isclose(r.score, one[r.doc_id].score, rel_tol=1e-6)


def test_probabilities_of_a_byte_add_up(monkeypatch):
    import numpy as np

    texts = [b"abracadabra", b"abba", b"cadab"]
    seq = np.unique(ct.sequences(texts))
    context = seq[3] >> 8
    every = np.unique(np.concatenate([seq, context << 8 | np.arange(256)]))
    n = np.array([(ct.sequences(texts) == s).sum() for s in every])
    deep = ct.levels(every, n, 0)
    p = 10 ** ct.log_probabilities(every, deep)
    assert math.isclose(p[every >> 8 == context].sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [0, 70, 900])
def test_parts_keep_together_what_shares_two_bytes(monkeypatch, hot):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ct, "TOGETHER", 64)
    rng = np.random.default_rng(hot)
    seq = np.unique(np.concatenate([rng.integers(0, 1 << 40, 400), (77 << 24) + rng.integers(0, 1 << 24, hot)]))
    n = rng.integers(0, 9, len(seq))
    batches = [pa.RecordBatch.from_arrays([pa.array(seq[i:i + 10]), pa.array(n[i:i + 10])], ["seq", "n"])
               for i in range(0, len(seq), 10)]
    parts = list(ct._runs([batches[0].slice(0, 0), *batches]))
    assert (np.concatenate([s for s, _ in parts]) == seq).all() and (np.concatenate([c for _, c in parts]) == n).all()
    assert len(parts) > 2
    for (a, _), (b, _) in zip(parts, parts[1:]):
        assert a[-1] >> 24 != b[0] >> 24
    assert list(ct._runs([])) == []


def test_documents(spark, sf_dir, plain):
    rows = QUERIES["op5_context_tree"](spark, sf_dir).collect()
    total, want = base(plain)
    assert len(rows) == len(plain)
    for r in rows:
        text = next(t for i, t in plain if i == r.doc_id)
        n, known, score = want[r.doc_id, text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (len((text or "").encode()) + 1), rel_tol=1e-9)
    # Held-out prose costs far less than eight bits a byte, and less than under the word counts.
    apart = [r for r in rows if r.held_out and r.n_tokens > 100]
    bits = sum(-r.score for r in apart) / math.log10(2) / sum(
        len((t or "").encode()) for i, t in plain if any(r.doc_id == i for r in apart))
    assert bits < 3.5


def test_odd_inputs(tricky, nothing):
    docs = [(r.doc_id, r.text) for r in tricky.collect() if len(r.text or "") < 1000]
    rows = [r for r in ct.scores(tricky).collect()]
    assert len(rows) == tricky.count()
    total, want = base([(r.doc_id, r.text) for r in tricky.collect()])
    got = sorted((r.n_tokens, r.n_known) for r in rows if r.doc_id not in (5, 6))
    assert got == sorted(want[d][:2] for d in docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert ct.scores(nothing).count() == 0


def test_no_training_texts(spark):
    only = next(i for i in range(100) if held(i))
    r = ct.scores(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert math.isclose(r.score, 3 * 8 * math.log10(.5), rel_tol=1e-6)


@pytest.mark.parametrize("halves", [1, 2, 3, 100, 8191, 8192, 20001, 10 ** 9])
def test_log_gamma(halves):
    import numpy as np

    assert math.isclose(ct.log_gamma(np.array([halves]))[0], math.lgamma(halves / 2), rel_tol=1e-11, abs_tol=1e-12)
