"""Personal data: candidate spans from wide patterns, judged by boosted trees, redacted above calibrated thresholds.

Four base kinds (email, ip, card, phone) are found by fixed rules and always reported.
Beyond them, generators with high recall propose spans that may overlap: written-out
addresses, numbers without a plus sign, grouped identity and account numbers. Boosted trees
score a candidate by its format and by the words and characters around it. The trees
are fitted here, on candidates of a bounded sample of distinct texts: what the base rules
confirm is varied (signs dropped, addresses written out, digits broken) into positive examples and
look-alikes, and candidates that fail the check of their own format are negative. One that passes it
without being confirmed may be real, so it is no example of either. A part
held back calibrates the scores, and each kind gets the threshold from which on the calibrated
part was right in ``PRECISION`` of the cases.

Defined cases: NULL and empty texts have no spans; repeated rows are judged alike; a table
without candidates gives trees fitted on varied examples alone; overlapping
accepted candidates count by score, base spans win over all. Each row is handled where it is
read, so nothing but the sample is moved.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import hashed_sample, per_text, slices

# Texts that the trees are fitted on, at most.
SAMPLE = 1500
EXAMPLES = 10_000
TREES, DEPTH, RATE = 60, 3, 0.2
PRECISION = 0.98
AROUND = 32

KINDS = ("email", "ip", "card", "phone")
MORE = ("written_email", "local_phone", "identity_number", "account_number", "six_ip")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# -- base rules ------------------------------------------------------------------

LOCAL = string.ascii_letters + string.digits + "._%+-"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only; the longest run is the only one that can go on.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(number: str) -> bool:
    """Whether the weighted digit sum, every second digit from the right doubled, is a multiple of ten."""
    values = [int(d) for d in reversed(number)]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(values)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """An address's local part is the whole run of its characters before the sign."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = done + len(text[done:sign].rstrip(LOCAL))
        match = EMAIL.match(text, start) if start < sign else None
        done = match.end() if match else sign + 1
        if match:
            yield Span("email", start, done)
        sign = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """What the fixed rules find, by start, then by kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [Span("ip", *m.span()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                number = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(number) <= 19 and luhn(number):
                    found.append(Span("card", *m.span()))
        if "+" in text:
            found += [Span("phone", *m.span()) for m in PHONE.finditer(text)
                      if 10 <= sum(map(m[0].count, string.digits)) <= 15]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


# -- candidates --------------------------------------------------------------------

GENERATORS = {kind: re.compile(pattern, re.ASCII) for kind, pattern in {
    "written_email":
        r"[A-Za-z0-9._-]{2,64}\x20?(?:\[at\]|\(at\)|\x20at\x20|@)\x20?[A-Za-z0-9-]{2,63}"
        r"(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "local_phone": r"(?<![\w.+-])(?<!\d\x20)\(?\d{2,4}\)?[\x20./-]{1,2}\d{3,4}(?:[\x20.-]\d{2,5}){1,3}(?![\w-]|\x20\d)",
    "identity_number": r"(?<![\w.-])\d{3}[-\x20]\d{2}[-\x20]\d{4}(?![\w-])",
    "account_number":
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "six_ip": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![\w:])",
}.items()}
# An address is proposed where a text writes out a dot or has the sign.
MARKED = re.compile(r"\[dot\]|\(dot\)|\x20dot\x20|@")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    found: list[Span] = []
    has_digit = DIGIT.search(text) is not None
    for kind, pattern in GENERATORS.items():
        if kind == "written_email":
            if MARKED.search(text):
                found += [Span(kind, *m.span()) for m in pattern.finditer(text)]
        elif has_digit and (kind != "six_ip" or ":" in text):
            found += [Span(kind, *m.span()) for m in pattern.finditer(text)]
    return found


CONTEXT = ("mail", "phone", "tel", "call", "fax", "mobile", "card", "account", "iban", "ssn", "social", "address",
           "contact", "ip", "order", "version", "page", "price", "isbn", "date")
MONEY = "$€£%#"


def bank_check(text: str) -> bool:
    """The account number's remainder: letters count from ten, the first four characters go last."""
    code = text.replace(" ", "")
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


# Kinds with a check of their own.
CHECKED = ("account_number", "identity_number", "six_ip")
REACHED = re.compile("mail|phone|tel|call|fax|mobile|contact|reach|write|address", re.I)


def checked(kind: str, said: str) -> bool:
    """Whether an account number's digits, an identity number's groups or an address of eight groups are valid."""
    if kind == "account_number":
        return bank_check(said)
    if kind == "identity_number":
        area, group, serial = re.findall("[0-9]+", said)
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind == "six_ip":
        try:
            return bool(ipaddress.IPv6Address(said))
        except ValueError:
            return False
    return False


def plausible(text: str, span: Span) -> bool:
    """Whether a candidate passes the check of its own format, so that it may well be real."""
    said = text[span.start:span.end]
    if span.kind in CHECKED:
        return checked(span.kind, said)
    groups = re.findall("[0-9]+", said)
    reached = REACHED.search(text[max(0, span.start - AROUND):span.start] + " " + text[span.end:span.end + AROUND]) is not None
    if span.kind == "local_phone":
        sizes, number = list(map(len, groups)), "".join(groups)
        return 7 <= len(number) <= 15 and (
            reached or said[0] == "(" or (sizes == [3, 3, 4] and number[0] > "1") or (number[0] == "0" and 9 <= len(number) <= 12))
    return reached or "[" in said or "(" in said


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    said = text[span.start:span.end]
    before, after = text[max(0, span.start - AROUND):span.start], text[span.end:span.end + AROUND]
    number = digits(said)
    groups = re.findall(r"\d+", said)
    words = (before + " " + after).lower()
    return [
        *(float(span.kind == k) for k in MORE),
        len(said), len(number), sum(map(str.isalpha, said)), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), len(set(number)), float(luhn(number)) if len(number) > 1 else 0.0,
        float(checked(span.kind, said)), said.count("."), said.count("-"), said.count(" "),
        said.count("(") - said.count(")"), float("@" in said), float(bool(MARKED.search(said))),
        len(re.findall(r"[A-Za-z]+$", said)[0]) if said[-1:].isalpha() else 0,
        float(said[:1] in "0+("), float(number[:3] in ("000", "666")), float(int(groups[0]) <= 31 if groups and len(groups[0]) < 6 else 0),
        float(any(g[:2] in ("19", "20") and len(g) == 4 for g in groups)),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(before[-1:] == "+"),
        float(any(c in MONEY for c in before[-2:] + after[:2])), sum(map(str.isdigit, before + after)),
        *(float(w in words) for w in CONTEXT),
    ]


# -- trees -----------------------------------------------------------------------

@dataclass
class Tree:
    """Splits in heap order: feature (-1: a leaf), border, value."""

    feature: list[int] = field(default_factory=list)
    border: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def of(self, row: list[float]) -> float:
        at = 0
        while self.feature[at] >= 0:
            at = 2 * at + 1 + (row[self.feature[at]] > self.border[at])
        return self.value[at]


def grow(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int) -> Tree:
    """A tree of second-order steps: the best borders among each feature's distinct values."""
    size = 2 ** (depth + 1) - 1
    tree = Tree([-1] * size, [0.0] * size, [0.0] * size)
    at = {0: np.arange(len(rows))}
    for node in range(size):
        held = at.pop(node, None)
        if held is None:
            continue
        g, h = slope[held].sum(), curve[held].sum()
        tree.value[node] = -g / (h + 1.0)
        if 2 * node + 2 >= size:
            continue
        best = (1e-3, -1, 0.0)
        for f in range(rows.shape[1]):
            order = held[np.argsort(rows[held, f], kind="stable")]
            values = rows[order, f]
            edges = np.nonzero(values[1:] > values[:-1])[0]
            if not len(edges):
                continue
            gl, hl = np.cumsum(slope[order])[edges], np.cumsum(curve[order])[edges]
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, (values[edges[k]] + values[edges[k] + 1]) / 2)
        if best[1] >= 0:
            tree.feature[node], tree.border[node] = best[1], float(best[2])
            right = rows[held, best[1]] > best[2]
            at[2 * node + 1], at[2 * node + 2] = held[~right], held[right]
    return tree


@dataclass
class Model:
    """Trees, the line that calibrates their sum, and a threshold per kind."""

    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0
    threshold: dict[str, float] = field(default_factory=dict)

    def raw(self, row: list[float]) -> float:
        return RATE * sum(t.of(row) for t in self.trees)

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.raw(row) + self.shift))))

    def accepts(self, text: str, span: Span) -> float | None:
        p = self.probability(features(text, span))
        return p if p >= self.threshold.get(span.kind, 2.0) else None


def boost(rows: np.ndarray, labels: np.ndarray) -> list[Tree]:
    total, trees = np.zeros(len(rows)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(rows, p - labels, p * (1 - p), DEPTH))
        total += RATE * np.array([trees[-1].of(r) for r in rows.tolist()])
    return trees


def calibrated(trees: list[Tree], rows: list[list[float]], kinds: list[str], labels: np.ndarray) -> Model:
    """Fit the line on examples that the trees have not seen, then the thresholds."""
    model = Model(trees)
    raw = np.array([model.raw(r) for r in rows])
    a, b = 1.0, 0.0
    for _ in range(200):  # a small logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a -= 0.5 * float(np.mean((p - labels) * raw)) / max(1.0, float(np.mean(raw ** 2)))
        b -= 0.5 * float(np.mean(p - labels))
    model.slope, model.shift = a, b
    p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
    for kind in MORE:
        own = np.array([k == kind for k in kinds], bool)
        order = np.argsort(-p[own])
        right = np.cumsum(labels[own][order]) / np.arange(1, own.sum() + 1)
        good = np.nonzero(right >= PRECISION)[0]
        if len(good):
            model.threshold[kind] = max(0.5, float(p[own][order][good[-1]]))
    return model


# -- examples ---------------------------------------------------------------------

def vary(base: Span, said: str, rng: random.Random) -> tuple[str, int] | None:
    """A confirmed span as its owner might also write it (1), or one that only looks like it (0)."""
    if base.kind == "email":
        at = rng.choice((" at ", " [at] ", "(at)", "[at]"))
        dot = rng.choice((" dot ", " [dot] ", "(dot)", "[dot]"))
        name, domain = said.split("@")
        return name + at + domain.replace(".", dot), 1
    if base.kind == "phone":
        number = digits(said)[-10:]
        if rng.random() < 0.5:
            join = rng.choice(("-", ".", " "))
            return rng.choice((f"({number[:3]}) {number[3:6]}-{number[6:]}", join.join((number[:3], number[3:6], number[6:])))), 1
        return f"{number[:4]}.{number[4:8]}.{number[8:]}", 0  # a version or a file number
    if base.kind == "card":
        number = digits(said)
        if rng.random() < 0.5:
            area = rng.choice((rng.randint(1, 665), rng.randint(667, 899), 0, 666, rng.randint(900, 999)))
            said = f"{area:03d}-{number[3:5]}-{number[5:9]}"
            return said, int(checked("identity_number", said))
        return f"{number[:3]} {number[3:6]} {number[6:9]} {number[9:12]}", 0  # a large amount
    words = said.split(".")
    if rng.random() < 0.5:
        return ":".join(f"{int(w) * 251:x}" for w in words + words), 1
    return ":".join(f"{int(w) % 60:02d}" for w in words), 0  # a time


def account(rng: random.Random) -> tuple[str, int]:
    """An account number whose check digits are right (1) or not (0)."""
    body = "".join(rng.choices(string.digits, k=rng.choice((14, 16, 18))))
    country = "".join(rng.choices(string.ascii_uppercase, k=2))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    right = rng.random() < 0.5
    return f"{country}{check if right else (check + rng.randint(1, 96)) % 97:02d}{body}", int(right)


def identity(rng: random.Random) -> tuple[str, int]:
    """An identity number with valid groups (1) or an area that is never given (0)."""
    right = rng.random() < 0.5
    area = rng.choice((rng.randint(1, 665), rng.randint(667, 899))) if right else rng.choice((0, 666, rng.randint(900, 999)))
    return f"{area:03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", int(right)


def six_groups(rng: random.Random) -> tuple[str, int]:
    """An address of eight groups, zeros left out or not (1), or a time or a device's number (0)."""
    if rng.random() < 0.5:
        groups = [f"{rng.randrange(1 << rng.choice((4, 12, 16))):x}" for _ in range(8)]
        return (":".join(groups) if rng.random() < 0.6 else ":".join(groups[:rng.randint(3, 6)]) + "::" + groups[7]), 1
    if rng.random() < 0.5:
        return ":".join(f"{rng.randrange(60):02d}" for _ in range(rng.randint(4, 5))), 0
    return ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), 0


class Places:
    """Disjoint stretches of a text, in order: whether a span touches one is found by halving."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s in sorted(spans, key=lambda s: s.start):
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def touch(self, span: Span) -> bool:
        at = bisect_right(self.ends, span.start)
        return at < len(self.starts) and self.starts[at] < span.end

    def add(self, span: Span) -> None:
        """A span that touches none."""
        at = bisect_right(self.ends, span.start)
        self.starts.insert(at, span.start)
        self.ends.insert(at, span.end)


DRAWN = {"account_number": account, "identity_number": identity, "six_ip": six_groups}


def examples(texts: list[str], seed: int = 7) -> tuple[list[list[float]], list[str], list[int]]:
    """Features, kinds and labels: candidates in the texts as they are, and varied ones in their place.

    Candidates that may well be real are not counted against their kind; drawn ones take their place.
    """
    rng = random.Random(seed)
    rows, kinds, labels = [], [], []

    def add(text: str, span: Span, label: int) -> None:
        rows.append(features(text, span))
        kinds.append(span.kind)
        labels.append(label)

    def put(text: str, at: Span, said: str, label: int) -> None:
        """Candidates that touch what is said in place of a span."""
        start, end = max(0, at.start - 2 * AROUND), at.end + 2 * AROUND
        window = text[start:at.start] + said + text[at.end:end]
        for span in candidates(window):
            if span.start < at.start - start + len(said) and at.start - start < span.end:
                # What covers little of the varied text says nothing about it.
                whole = abs(span.start - (at.start - start)) <= 1 and abs(span.end - (at.start - start) - len(said)) <= 1
                add(window, span, label if whole else 0)

    filler = [f"{rng.choice(('call', 'write to', 'see', 'order', 'page'))} {x} today" for x in
              ("ann.lee@mail.example.com", "+1 (415) 555-0132", "4111111111111111", "10.20.30.40") for _ in range(40)]
    for text in texts or filler:
        base = base_spans(text)
        held = Places(base)
        for span in candidates(text):
            inside = held.touch(span)
            if not inside and not plausible(text, span):
                add(text, span, 0)
            elif not inside and span.kind in DRAWN:
                put(text, span, *DRAWN[span.kind](rng))
        for b in base:
            varied = vary(b, text[b.start:b.end], rng)
            put(text, b, *(DRAWN[rng.choice(CHECKED)](rng) if rng.random() < 0.4 else varied))
    return rows, kinds, labels


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Trees and thresholds from about ``sample`` distinct texts with digits or a sign, chosen by hash.

    Examples are made in the task that holds the sample, those of a text with a seed of its own; at most ``EXAMPLES`` of them come back,
    the least by hash and in that order, so neither the layout of the table nor a repeated task changes the model.
    """
    marked = docs.where(F.col(text).rlike("[0-9]{3}|@")).select(text)
    # Counted by hashes; only texts of the sample are moved, as the filter by hash comes before distinct().
    some = hashed_sample(marked.distinct(), sample, text, of=marked.select(F.xxhash64(text)).distinct().count())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for said in batch.column(0).to_pylist():
                whole = hashlib.sha256(said.encode()).digest()
                rows, kinds, labels = examples([said], int.from_bytes(whole[:8], "big"))
                marks = [hashlib.sha256(whole + i.to_bytes(4, "big")).digest() for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.binary()), pa.array(rows, pa.list_(pa.float64())), pa.array(kinds, pa.string()),
                     pa.array(labels, pa.int32())], ["mark", "row", "kind", "label"])

    made = some.mapInArrow(task, "mark binary, row array<double>, kind string, label int").orderBy("mark").limit(EXAMPLES).collect()
    drawn = list(zip(*examples([])))
    made = [(r.row, r.kind, r.label) for r in made] + drawn
    held = np.array([i % 3 == 0 for i in range(len(made))])
    rows, kinds, labels = np.array([m[0] for m in made]), [m[1] for m in made], np.array([m[2] for m in made], float)
    trees = boost(rows[~held], labels[~held])
    return calibrated(trees, rows[held].tolist(), [k for k, h in zip(kinds, held) if h], labels[held])


# -- result ------------------------------------------------------------------------

def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Accepted candidates that overlap neither a base span nor a better candidate."""
    judged = sorted(((p, s) for s in candidates(text) if (p := model.accepts(text, s)) is not None),
                    key=lambda x: (-x[0], x[1].start, MORE.index(x[1].kind)))
    taken, added = Places(base), []
    for _, span in judged:
        if not taken.touch(span):
            taken.add(span)
            added.append(span)
    return added


def spans(text: str, model: Model) -> list[Span]:
    base = base_spans(text)
    return sorted(base + added_spans(text, base, model), key=lambda s: (s.start, (KINDS + MORE).index(s.kind)))


def written(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, of every row."""
    model = model or fit(docs, text)

    def digest(t: str) -> tuple:
        base = base_spans(t)
        every = sorted(base + added_spans(t, base, model), key=lambda s: (s.start, (KINDS + MORE).index(s.kind)))
        counts = [sum(s.kind == k for s in base) for k in KINDS]
        return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)

    return per_text(docs, f"{key} {docs.schema[key].dataType.simpleString()}, "
                    + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string",
                    lambda: digest, text, (key,))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``key`` and the text with every span replaced by its kind in brackets; overlapping spans as one."""
    model = model or fit(docs, text)

    def clean(t: str) -> tuple:
        out, at = [], 0
        for s in spans(t, model):
            if s.start >= at:
                out += [t[at:s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        return ("".join(out) + t[at:],)

    return per_text(docs, f"{key} {docs.schema[key].dataType.simpleString()}, {text} string", lambda: clean, text, (key,))
