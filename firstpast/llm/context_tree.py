"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, and each is predicted from the ``DEPTH`` bytes before
it. Every context of every depth has Krichevsky-Trofimov estimates of its decisions;
a context's weight is set against that of its extensions by how well either explains the
training texts, and the prediction mixes the estimates of all depths by these weights. A context
without training data says nothing: the mix ends at the last one that has some. A text is followed by a
zero byte, so that the probabilities of all texts add up, and preceded by ``DEPTH`` of them.

How it is dealt out:

1. Tasks lay texts into chunks of ``CHUNK`` bytes, written compressed to the shared folder.
2. From each chunk come its distinct byte sequences of length ``DEPTH + 1``, and its distinct words, with their
   counts in training texts. As a chunk gives a sequence once, no key is hotter than the number of chunks.
3. Summed over chunks, the sequences are the tree's leaves. They are dealt out by the two most
   recent bytes, of which each has at most ``256 ** (DEPTH - 1)`` sequences below it, and weights are worked out
   from the leaves up. What reaches depth one and zero has at most 256 * 255 rows.
4. Each sequence's log-probability and each word's count go back to the chunks that hold it, where the
   texts are scored. Nothing that grows with the corpus is broadcast or sent to the driver.

Defined cases: NULL counts as the empty text, which is one end token and one zero byte; repeated rows are
training data and are scored as often as they occur; NULL ids fold like the empty text; without
training texts every decision has probability one half and N and V are zero; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstpast.llm.common import arrow_schema, fold, slices
from firstpast.session import materialize

DEPTH = 4
CHUNK = 8 << 20
FOLDS, HELD = 7, 2
# Sequences whose weights are worked out together; more only if two bytes have more below them.
TOGETHER = 1 << 19


# -- chunks ------------------------------------------------------------------------

_CHUNK = "chunk long, held array<boolean>, sizes array<long>, data binary"


def chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of whole texts, lower-cased, end to end; a text longer than a chunk has one of its own."""
    schema = f"{_CHUNK}, keys array<{docs.schema[key].dataType.simpleString()}>"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            keys, folds, said = zip(*held)
            data = zstandard.compress(b"".join(said), 3)
            values = ([number], [list(folds)], [[len(s) for s in said]], [data], [list(keys)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], schema=fields)

        for batch in slices(batches):
            for one, out, said in zip(*(c.to_pylist() for c in batch.columns)):
                data = (said or "").encode().lower()
                if held and size + len(data) > CHUNK:
                    yield chunk()
                    held.clear()
                    number, size = number + 1, 0
                held.append((one, out, data))
                size += len(data)
        if held:
            yield chunk()

    return docs.select(key, (fold(key, FOLDS) == HELD).alias("held"), text).mapInArrow(task, schema)


def _texts(sizes: Iterable[int], data: bytes) -> list[bytes]:
    whole, ends = zstandard.decompress(data), np.cumsum(sizes).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def sequences(texts: list[bytes]) -> np.ndarray:
    """For every byte of every text and the zero behind it: the bytes before it, the most recent first, and itself."""
    before = bytes(DEPTH)
    padded = np.frombuffer(b"".join(x for t in texts for x in (before, t, b"\0")), np.uint8)
    key = np.zeros(max(0, len(padded) - DEPTH), np.int64)  # of every place but the first, in place
    for back in [*range(1, DEPTH + 1), 0]:
        key <<= 8
        key |= padded[DEPTH - back:len(padded) - back]
    of_text = np.ones(len(key), bool)
    at = -DEPTH
    for t in texts:
        of_text[max(at, 0):max(at + DEPTH, 0)] = False
        at += DEPTH + len(t) + 1
    return key[of_text]


def word_numbers(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a chunk in order of their first occurrence, the number of every word, words per text."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    sizes: list[int] = []

    def numbers() -> Iterator[int]:
        for t in texts:
            words = t.split()
            sizes.append(len(words))
            yield from map(seen.__getitem__, words)

    found = np.fromiter(numbers(), np.int64)
    return list(seen), found, np.array(sizes, np.int64)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes."""
    out = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def leaves(laid: DataFrame) -> DataFrame:
    """``(seq, n, chunk, place)``: a chunk's distinct sequences, by first occurrence, with their count in training texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            chunk, held, sizes, data = (c.to_pylist()[0] for c in batch.columns)
            number, seq = pd.factorize(sequences(_texts(sizes, data)))
            learned = np.repeat(~np.array(held), np.array(sizes) + 1)
            n = np.bincount(number[learned], minlength=len(seq))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seq), pa.array(n), pa.array(np.full(len(seq), chunk)), pa.array(np.arange(len(seq), dtype=np.int32))],
                ["seq", "n", "chunk", "place"])

    return laid.select("chunk", "held", "sizes", "data").mapInArrow(task, "seq long, n long, chunk long, place int")


def words(laid: DataFrame) -> DataFrame:
    """``(word, n, chunk, place)``: a chunk's distinct words with their count in training texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            chunk, held, sizes, data = (c.to_pylist()[0] for c in batch.columns)
            seen, numbers, per_text = word_numbers(_texts(sizes, data))
            n = np.bincount(numbers[np.repeat(~np.array(held), per_text)], minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.binary()), pa.array(n), pa.array(np.full(len(seen), chunk)),
                 pa.array(np.arange(len(seen), dtype=np.int32))], ["word", "n", "chunk", "place"])

    return laid.select("chunk", "held", "sizes", "data").mapInArrow(task, "word binary, n long, chunk long, place int")


# -- weights -----------------------------------------------------------------------

_SMALL = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(1 << 13)])


def log_gamma(halves: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function at halves / 2."""
    small = _SMALL[np.minimum(halves, len(_SMALL) - 1)]
    x = np.maximum(halves, 2) / 2.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(halves < len(_SMALL), small, series)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability that the estimator gives to so many zeros and ones."""
    return log_gamma(2 * n0 + 1) + log_gamma(2 * n1 + 1) - log_gamma(2 * (n0 + n1) + 2) - math.log(math.pi)


class Nodes:
    """Binary decisions of some contexts, as sorted keys ``context << 8 | bits so far under a leading one``."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray):
        """From sorted (context, byte) with counts."""
        keys, zeros, ones = [], [], []
        for level in range(8):
            key = context << 8 | 1 << level | byte >> (8 - level)
            start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            bit = byte >> (7 - level) & 1
            keys.append(key[start])
            zeros.append(np.add.reduceat(np.where(bit, 0, n), start))
            ones.append(np.add.reduceat(np.where(bit, n, 0), start))
        order = np.argsort(key := np.concatenate(keys))
        self.key, self.n0, self.n1 = key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
        self.kt = kt(self.n0, self.n1)
        self.weight = np.ones(len(self.key))  # of the node's own estimate
        self.log = self.kt

    def mix(self, below: Nodes) -> None:
        """Weigh the own estimates against the product of the extensions'."""
        parent = below.key >> 16 << 8 | below.key & 255
        extended = np.bincount(np.searchsorted(self.key, parent), below.log, len(self.key))
        self.weigh(extended)

    def weigh(self, extended: np.ndarray) -> None:
        self.weight = 1 / (1 + np.exp(np.clip(extended - self.kt, -700, 700)))
        self.log = np.logaddexp(self.kt, extended) - math.log(2)

    def of(self, context: np.ndarray, byte: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, weight and estimate of the byte's decision at a level."""
        at = np.searchsorted(self.key, context << 8 | 1 << level | byte >> (8 - level))
        n0, n1 = self.n0[at], self.n1[at]
        total = n0 + n1
        return total, self.weight[at], (np.where(byte >> (7 - level) & 1, n1, n0) + 0.5) / (total + 1)


def levels(seq: np.ndarray, n: np.ndarray, top: int = 2) -> dict[int, Nodes]:
    """The nodes of depth ``top`` to ``DEPTH`` over sorted sequences, weighted from the leaves up."""
    made: dict[int, Nodes] = {}
    byte = seq & 255
    for depth in range(DEPTH, top - 1, -1):
        pair = seq >> 8 * (DEPTH + 1 - depth) << 8 | byte
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        start = np.nonzero(np.r_[True, pair[1:] != pair[:-1]])[0]
        made[depth] = Nodes(pair[start] >> 8, pair[start] & 255, np.add.reduceat(n[order], start))
        if depth < DEPTH:
            made[depth].mix(made[depth + 1])
    return made


def log_probabilities(seq: np.ndarray, deep: dict[int, Nodes]) -> np.ndarray:
    """Base-ten log-probability of each sequence's last byte given the bytes before it."""
    byte, total = seq & 255, np.zeros(len(seq))
    for level in range(8):
        mixed = below = None
        for depth in range(DEPTH, -1, -1):
            count, weight, own = deep[depth].of(seq >> 8 * (DEPTH + 1 - depth), byte, level)
            mixed = own if mixed is None else np.where(below > 0, weight * own + (1 - weight) * mixed, own)
            below = count
        total += np.log10(mixed)
    return total


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (seq, n) rows in parts that keep together what shares its two most recent bytes."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, enough = 0, TOGETHER

    def joined() -> tuple[np.ndarray, np.ndarray]:
        seq, n = (np.concatenate(column) for column in zip(*parts))
        return seq, n

    for batch in batches:
        if batch.num_rows:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
        if held >= enough:
            seq, n = joined()
            end = int(np.searchsorted(seq, seq[-1] >> 8 * (DEPTH - 1) << 8 * (DEPTH - 1)))
            if end:
                yield seq[:end], n[:end]
            parts, held = [(seq[end:], n[end:])], len(seq) - end
            # What cannot be cut yet is put together again only after it has doubled.
            enough = max(TOGETHER, 2 * held)
    if held:
        yield joined()


def tops(counts: DataFrame) -> dict[int, Nodes]:
    """The nodes of depth one and zero."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, n in _runs(batches):
            deep = levels(seq, n)[2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(deep.key >> 16), pa.array(deep.key & 255), pa.array(deep.n0), pa.array(deep.n1), pa.array(deep.log)],
                ["recent", "node", "n0", "n1", "below"])

    deepest = counts.mapInArrow(task, "recent long, node long, n0 long, n1 long, below double")
    # At most 256 * 255 rows, whatever the corpus.
    rows = deepest.groupBy("recent", "node").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toPandas()
    one, root = Nodes.__new__(Nodes), Nodes.__new__(Nodes)
    rows = rows.assign(key=rows.recent * 256 + rows.node).sort_values("key")
    for nodes, found in ((one, rows), (root, rows.groupby("node", as_index=False).sum().assign(key=lambda x: x.node))):
        nodes.key, nodes.n0, nodes.n1 = (found[c].to_numpy(np.int64) for c in ("key", "n0", "n1"))
        nodes.kt = kt(nodes.n0, nodes.n1)
        if nodes is one:
            one.weigh(rows.below.to_numpy(float))
        else:
            root.mix(one)
    return {1: one, 0: root}


def model(counts: DataFrame) -> DataFrame:
    """``(seq, value)`` of the counted sequences ``(seq, n)``."""
    dealt = counts.repartition(F.shiftright("seq", 8 * (DEPTH - 1))).sortWithinPartitions("seq").select("seq", "n")
    top = tops(dealt)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, n in _runs(batches):
            value = log_probabilities(seq, levels(seq, n) | top)
            for at in range(0, len(seq), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seq[at:at + (1 << 16)]), pa.array(value[at:at + (1 << 16)].astype(np.float32))], ["seq", "value"])

    return dealt.mapInArrow(task, "seq long, value float")


# -- scores ------------------------------------------------------------------------

def scores(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: tokens, how many of them training texts hold, the base and the model's log-probability.

    ``bits_per_byte`` is the model's code length of the text and its end, per byte of both.
    """
    laid = materialize(chunks(docs, text, key), "chunks")
    found = materialize(leaves(laid), "leaves")
    counts = materialize(found.groupBy("seq").agg(F.sum("n").alias("n")), "sequence-counts")
    value = materialize(model(counts), "sequence-values")
    of_leaves = found.select("seq", "chunk", "place").join(value, "seq").select(
        "chunk", "place", F.col("value").cast("double").alias("value"))
    # A word has a row for each chunk at most, so its rows in one window are few beside all of them.
    alike = Window.partitionBy("word")
    counted = materialize(
        words(laid).select("chunk", "place", "n", F.sum("n").over(alike).alias("c"),
                           (F.min("chunk").over(alike) == F.col("chunk")).alias("first")), "word-counts")
    ends = laid.select(F.explode("held").alias("held")).where("NOT held").count()
    total = counted.agg(F.sum("n"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    train, distinct = (total[0] or 0) + ends, total[1] + (ends > 0)
    # Words take the places below zero.
    of_words = counted.select("chunk", (-1 - F.col("place")).alias("place"), F.col("c").cast("double").alias("value"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, bits_per_byte double")
    fields = arrow_schema(schema)

    def task(chunk: pa.Table, known: pa.Table) -> pa.Table:
        held, sizes, data, keys = (chunk.column(c).to_pylist()[0] for c in ("held", "sizes", "data", "keys"))
        place, value = known.column("place").to_numpy(), known.column("value").to_numpy()
        word = place < 0
        count, logs = np.zeros(word.sum()), np.zeros((~word).sum())
        count[-1 - place[word]] = value[word]
        logs[place[~word]] = value[~word]
        texts = _texts(sizes, data)
        _, numbers, per_text = word_numbers(texts)
        base = np.log10((count + 1) / (train + distinct + 1))
        end = math.log10((ends + 1) / (train + distinct + 1))
        coded = np.array(sizes) + 1
        score = sums(logs[pd.factorize(sequences(texts))[0]], coded)
        made = (keys, held, per_text + 1, sums((count > 0)[numbers], per_text).astype(np.int64) + (ends > 0),
                np.full(len(texts), train), sums(base[numbers], per_text) + end, score,
                -score / (math.log10(2) * coded))
        return pa.table([pa.array(c, f.type) for c, f in zip(made, fields)], schema=fields)

    known = of_leaves.union(of_words)
    return laid.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(task, schema)
