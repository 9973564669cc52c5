"""Quality classifier: Bradley-Terry scores learned from preference pairs, a threshold at a score quantile.

Every text has features of its wording and layout. A pair prefers a text of label 1 to one of
label 0, and the model is the weighting under which preferred texts score higher: logistic loss on
the difference of the two feature rows, without an intercept, as only differences count. The threshold is the
quantile of the training scores at which both labels are told apart best (balanced accuracy); reported
scores are probabilities with ``ACCEPTED`` at that quantile.

The labelled rows fitted on are about ``PER_LABEL`` of each label (never twice as many), chosen by hash; only their
features come to the driver. An id that stands for several texts brings ``PER_ID`` of them at most, and where that
makes too many rows of a label, those with the lowest hashes stay. Scoring is done in the tasks that read the texts.

Defined cases: NULL and empty texts have the features of the empty text; labels other than 0 and 1 and those of
NULL ids are not learned from; a document with both labels counts under each; where one label is missing there is
nothing to prefer, and every text scores one half; repeated rows score alike; extra columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import filter_texts, fold, hashed_sample, per_text, slices
from firstpast.session import materialize

PER_LABEL = 4000
# Texts of one id and label, at most.
PER_ID = 4
PAIRS = 40_000
RIDGE = 1e-3
STEPS = 25
ACCEPTED = 0.3
FOLDS, HELD = 5, 0

_UPPER = re.compile(r"[A-Z]")
_DIGITS = re.compile(r"[0-9]")
_SYMBOLS = "#*$%&|<>{}\\^~=_"
_ENDS = ".!?"
_BULLETS = (b"-", b"*", b"#", b"|", b">", "•".encode())

NAMES = ("log_words", "few_words", "word_length", "long_word", "symbols", "digits", "upper", "spaces", "commas", "stops",
         "shouts", "distinct_words", "rare_variety", "stutters", "repeated_windows", "repeated_lines", "line_words",
         "bullet_lines", "marked_words", "top_word", "short_words", "capital_words", "ratio", "ratio_gap", "beyond_ascii",
         "unfinished", "bars", "lone_letters")


def features(text: str, compressor: zstandard.ZstdCompressor) -> list[float]:
    """The features of one whole text, in the order of ``NAMES``."""
    data = text.encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(text))
    found = Counter(words)
    distinct = len(found)
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    ratio = len(compressor.compress(data)) / max(1, len(data))
    expected = 0.36 + 2.2 / math.sqrt(len(data) + 16)
    lengths = [len(w) for w in words]
    return [
        math.log1p(len(words)), max(0.0, 1 - len(words) / 50), sum(lengths) / n, math.log1p(max(lengths, default=0)),
        sum(map(text.count, _SYMBOLS)) / size, len(_DIGITS.findall(text)) / size, len(_UPPER.findall(text)) / size,
        (text.count(" ") + text.count("\n") + text.count("\t")) / size, text.count(",") / n,
        sum(map(text.count, _ENDS)) / n, text.count("!") / n, distinct / n, max(0.0, 0.3 - distinct / n),
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(windows)) / max(1, len(windows)),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        sum(line.lstrip().startswith(_BULLETS) for line in lines) / max(1, len(lines)),
        sum(w[-1] in b"#*$%&|" for w in words) / n, max(found.values(), default=0) / n, sum(x <= 2 for x in lengths) / n,
        sum(map(bytes.isupper, words)) / n, ratio if len(data) > 64 else 0.0, max(0.0, expected - ratio) if len(data) > 64 else 0.0,
        (len(data) - len(text)) / size, float(not text.rstrip().endswith(tuple(".!?\"'"))), data.count(b" | ") / n,
        sum(x == 1 for x in lengths) / n,
    ]


@dataclass
class Model:
    """Weights over standardised features, and the line from a score to a probability."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    border: float = 0.0
    slope: float = 0.0
    at_border: float = 0.5

    def raw(self, row: list[float]) -> float:
        return float(np.clip((np.array(row) - self.middle) / self.spread, -8, 8) @ self.weights)

    def score(self, row: list[float]) -> float:
        x = self.slope * (self.raw(row) - self.border) + math.log(self.at_border / (1 - self.at_border))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _newton(rows: np.ndarray, weights: np.ndarray, ridge: float) -> np.ndarray:
    """Weights under which every row, a difference, is most likely positive."""
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - 1) / len(rows) + ridge * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows / len(rows) + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights = weights - step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learn(rows: np.ndarray, labels: np.ndarray, seed: int = 3) -> Model:
    """Pairs drawn from both labels, weights from their differences, border and line from the scores."""
    width = len(NAMES)
    if not (labels == 0).any() or not (labels == 1).any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width))
    middle, spread = rows.mean(0), rows.std(0) + 1e-9
    scaled = np.clip((rows - middle) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = (rng.choice(np.nonzero(labels == k)[0], PAIRS) for k in (1, 0))
    weights = _newton(scaled[better] - scaled[worse], np.zeros(width), RIDGE)
    raw = scaled @ weights
    # Balanced accuracy of rejecting what lies below each quantile.
    order = np.argsort(raw, kind="stable")
    bad = labels[order] == 0
    gain = np.cumsum(bad) / bad.sum() - np.cumsum(~bad) / (~bad).sum()
    best = int(np.argmax(gain))
    border = float(raw[order[best]] + raw[order[min(best + 1, len(raw) - 1)]]) / 2
    # The line's slope from the same labels, with ACCEPTED at the border.
    slope, shift = 1.0, math.log(ACCEPTED / (1 - ACCEPTED))
    away = raw - border
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * away + shift, -30, 30)))
        slope -= float(np.mean((p - labels) * away)) / max(1e-9, float(np.mean(p * (1 - p) * away ** 2)) + 1e-3)
        slope = min(50.0, max(0.05, slope))
    return Model(middle, spread, weights, border, slope, ACCEPTED)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        per_label: int = PER_LABEL) -> Model:
    """A model of the labels; held-out ids are not learned from."""
    known = labels.where(F.col(key).isNotNull() & (fold(key, FOLDS) != HELD)).select(key, F.col(label).alias("label"))
    some = [hashed_sample(known.where(F.col("label") == k).distinct(), per_label, key) for k in (0, 1)]
    # At most 4 * per_label ids and labels.
    chosen = some[0].union(some[1])
    said = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("said")).withColumn("hash", F.xxhash64("said"))
    # Ids may repeat in documents: the rows are bounded per id and per label, by hashes of their texts.
    held = said.join(F.broadcast(chosen.withColumnRenamed(key, "id")), "id").groupBy(
        "label", "id", F.pmod("hash", F.lit(PER_ID)).alias("part")).agg(F.min("hash").alias("hash"))
    held = materialize(held.select("label", "id", "hash", F.xxhash64("id", "hash").alias("place")), "labelled-texts")
    picked = [held.where(F.col("label") == k).orderBy("place", "id").limit(2 * per_label) for k in (0, 1)]
    rows = said.join(F.broadcast(picked[0].union(picked[1])), ["id", "hash"]).select("label", "place", "said")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in slices(batches):
            kinds, places, made = [], [], []
            for label, place, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (label, place) not in seen:
                    seen.add((label, place))
                    kinds.append(label)
                    places.append(place)
                    made.append(features(t, compressor))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(made, pa.list_(pa.float64()))],
                ["label", "place", "row"])

    found = rows.mapInArrow(task, "label int, place long, row array<double>").dropDuplicates(["label", "place"])
    made = found.orderBy("label", "row").collect()
    return learn(np.array([r.row for r in made]).reshape(-1, len(NAMES)), np.array([r.label for r in made], float))


def _score(model: Model):
    compressor = zstandard.ZstdCompressor(level=3)
    return lambda t: model.score(features(t, compressor))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
           model: Model | None = None) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    model = model or fit(docs, labels, text, key)

    def make():
        score = _score(model)
        return lambda t: (s := score(t), int(s >= ACCEPTED))

    kind = docs.schema[key].dataType.simpleString()
    made = per_text(docs, f"{key} {kind}, score double, predicted int", make, text, (key,))
    return made.select(key, (fold(key, FOLDS) == HELD).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
         model: Model | None = None) -> DataFrame:
    """The rows whose text is accepted, with all their columns."""
    model = model or fit(docs, labels, text, key)

    def make():
        score = _score(model)
        return lambda t: score(t) >= ACCEPTED

    return filter_texts(docs, make, text)
