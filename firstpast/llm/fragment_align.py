"""Alignment of two tokenizers: byte ranges as fragments under an associative composition.

Text is cut into byte ranges. The tokens of both tokenizers that end in a range make a fragment: an open prefix
up to the first offset where tokens of both end, closed groups, and an open suffix after the last such
offset. Two neighbouring fragments compose by closing one group out of the left one's suffix and the right
one's prefix. That is associative, so the fragments of a long document are made by many tasks and
composed level by level, each task taking at most ``FAN`` ranges of the level below. The tree carries open ends and
counts; the texts of closed groups stay where they were made and are digested in order afterwards.

Texts of more than ``RANGE`` bytes are cut into segments before they are encoded, at a space between two letters
or digits. Neither tokenizer joins anything over such a place: the splitting rule of the one begins a word at
the space, and no piece of the other has a space mark behind another character (checked when its file is read). A
segment without such a place is encoded as a whole and then cut into ranges, whose tokens may reach over the cuts.

Linked tokens end together, so the shorter one's bytes end the longer one's. The number of id pairs is therefore
bounded by the vocabularies (``pair_bound``), whatever the corpus, and the table of their counts may go to every task.

Defined cases: NULL and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens and zeros;
rows are aligned one by one, so equal rows count twice and ids may repeat or be NULL; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firstpast.llm.common import arrow_schema, slices
from firstpast.session import materialize

RANGE = 1 << 16
FAN = 16
# A space where both tokenizers begin anew.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
MARK = "▁"


# -- tokenizers ------------------------------------------------------------------

class Tokens(NamedTuple):
    """A tokenizer of (space and) text: its function of a text, and every id's bytes."""
    encode: Callable[[str], list[int]]
    of_id: list[bytes]
    sizes: np.ndarray


def _tokens(encode: Callable[[str], list[int]], of_id: list[bytes]) -> Tokens:
    return Tokens(encode, of_id, np.array([len(b) for b in of_id], np.int64))


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokens:
    """A byte-level vocabulary file; special strings in a text are plain text. It is given the space."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    # Printable bytes stand for themselves, the others for code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    of_id = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in ranks.items():
        of_id[i] = token
    return _tokens(lambda text: encoding.encode_ordinary(" " + text), of_id)


@lru_cache(maxsize=2)
def pieces(path: str) -> Tokens:
    """A piece vocabulary file, which adds the space itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of_id = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_id.append(bytes([int(piece[3:5], 16)]))
        else:
            of_id.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
            if any(b == MARK != a for a, b in zip(piece, piece[1:])):
                raise ValueError(f"piece {i} has a space mark behind another character, so texts cannot be cut at spaces")
    return _tokens(model.encode, of_id)


def pair_bound(a: Tokens, b: Tokens) -> int:
    """At most so many id pairs can be linked: the bytes of one end the bytes of the other."""
    def ends(of: Tokens, among: Tokens) -> int:
        known: dict[bytes, int] = {}
        for token in filter(None, among.of_id):
            known[token] = known.get(token, 0) + 1
        return sum(known.get(token[k:], 0) for token in of.of_id for k in range(len(token)))

    return ends(a, b) + ends(b, a)


# -- fragments -------------------------------------------------------------------

Ids = tuple[list[int], list[int]]


class Fragment(NamedTuple):
    """The tokens that end in a byte range. Without a common end ``closes`` is False and all is ``prefix``.

    ``prefix`` ends with the first common end, ``suffix`` follows the last one. ``groups`` counts the closed
    groups between them, ``n_a`` and ``n_b`` count all tokens; ``at`` is the range of the first common end.
    """
    at: int
    closes: bool
    prefix: Ids
    suffix: Ids
    groups: int
    n_a: int
    n_b: int
    good: bool


EMPTY = Fragment(-1, False, ([], []), ([], []), 0, 0, 0, True)


def joined(x: Ids, y: Ids) -> Ids:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Ids | None]:
    """The fragment of both ranges, and the group that it closes, which belongs in front of range ``y.at``."""
    n_a, n_b, good = x.n_a + y.n_a, x.n_b + y.n_b, x.good and y.good
    if not y.closes:
        if not x.closes:
            return Fragment(-1, False, joined(x.prefix, y.prefix), ([], []), 0, n_a, n_b, good), None
        return x._replace(suffix=joined(x.suffix, y.prefix), n_a=n_a, n_b=n_b, good=good), None
    if not x.closes:
        return y._replace(prefix=joined(x.prefix, y.prefix), n_a=n_a, n_b=n_b, good=good), None
    return Fragment(x.at, True, x.prefix, y.suffix, x.groups + 1 + y.groups, n_a, n_b, good), joined(x.suffix, y.prefix)


class Stream(NamedTuple):
    """Tokens of a segment: ids and end offsets of both tokenizers, and whether they give the segment back."""
    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    good: bool


def stream(text: str, a: Tokens, b: Tokens) -> Stream:
    data = (" " + text).encode()
    ids, ends, good = [], [], True
    for tokens in (a, b):
        found = tokens.encode(text)
        good = good and b"".join(map(tokens.of_id.__getitem__, found)) == data
        of = np.array(found, np.int64)
        ids.append(of)
        ends.append(np.cumsum(tokens.sizes[of]))
    return Stream(tuple(ids), tuple(ends), good)


class Closed(NamedTuple):
    """Closed groups next to each other: their text and their links as (pair codes, how often each)."""
    text: str
    codes: np.ndarray
    times: np.ndarray


class Writer:
    """Texts and links of groups; a pair's code is ``a * pairs + b``."""

    def __init__(self, a: Tokens, b: Tokens):
        self.pairs = len(b.of_id)
        if len(a.of_id) * self.pairs >= 1 << 32:
            raise ValueError("pair codes of these vocabularies do not fit into 32 bits")
        # Every id with each of the marks that may follow it.
        self.names = [f"{i}{mark}" for i in range(max(len(a.of_id), self.pairs)) for mark in (",", "|", ";")]

    def groups(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], common: np.ndarray) -> Closed:
        """Groups that end at the common ends, from tokens of which the last ones end there."""
        if not len(common):
            return Closed("", np.empty(0, np.uint32), np.empty(0, np.uint32))
        of = [np.searchsorted(common, e) for e in ends]
        last = [np.searchsorted(e, common) for e in ends]
        codes, times = np.unique((ids[0][last[0]] * self.pairs + ids[1][last[1]]).astype(np.uint32), return_counts=True)
        named = []
        for k in (0, 1):
            names = ids[k] * 3
            names[last[k]] += 1 + k
            named.append(names)
        order = np.argsort(np.concatenate([of[0] * 2, of[1] * 2 + 1]), kind="stable")
        text = "".join(map(self.names.__getitem__, np.concatenate(named)[order].tolist()))
        return Closed(text[:-1], codes, times.astype(np.uint32))

    def group(self, ids: Ids) -> Closed:
        """One group; both lists hold a token, as every token has bytes."""
        code = np.array([ids[0][-1] * self.pairs + ids[1][-1]], np.uint32)
        text = "|".join(",".join(map(str, one)) for one in ids)
        return Closed(text, code, np.ones(1, np.uint32))


def fragment(tokens: Stream, low: int, high: int, at: int, writer: Writer) -> tuple[Fragment, Closed]:
    """The fragment of the tokens that end in (low, high], and its closed groups."""
    ids, ends = [], []
    for k in (0, 1):
        first, stop = np.searchsorted(tokens.ends[k], [low, high], "right")
        ids.append(tokens.ids[k][first:stop])
        ends.append(tokens.ends[k][first:stop])
    n_a, n_b = map(len, ids)
    common = np.intersect1d(*ends, assume_unique=True)
    if not len(common):
        return (Fragment(-1, False, tuple(i.tolist() for i in ids), ([], []), 0, n_a, n_b, tokens.good),
                writer.groups(ids, ends, common))
    cut = [np.searchsorted(e, [common[0], common[-1]], "right") for e in ends]
    inner = [i[c[0]:c[1]] for i, c in zip(ids, cut)], [e[c[0]:c[1]] for e, c in zip(ends, cut)]
    made = Fragment(at, True, tuple(i[:c[0]].tolist() for i, c in zip(ids, cut)),
                    tuple(i[c[1]:].tolist() for i, c in zip(ids, cut)), len(common) - 1, n_a, n_b, tokens.good)
    return made, writer.groups(*inner, common[1:])


def segments(text: str, size: int = RANGE) -> Iterator[str]:
    """The text cut where both tokenizers begin anew, about ``size`` bytes each; the spaces at the cuts are left out."""
    # A character has at most four bytes.
    start, step = 0, max(1, size // 4)
    while len(text) - start > step:
        found = SAFE.search(text, start + step)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


# -- the job -----------------------------------------------------------------------

# One row of a whole short text, of a segment, of a fragment or of a closed group of a longer one.
_DONE = "n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, times binary"
_LEAF = ("row long, at long, part int, closes boolean, first_at long, prefix_a array<int>, prefix_b array<int>, "
         "suffix_a array<int>, suffix_b array<int>, groups long, n_a long, n_b long, good boolean, text string, codes binary, times binary")
_NO_DIGEST = ""


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _batches(rows: Iterable[tuple], fields: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, fields)
            held = []
    if held:
        yield _batch(held, fields)


def _rows(batches: Iterable[pa.RecordBatch], size: int = 64) -> Iterator[tuple]:
    for batch in slices(batches, size):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _sum_links(parts: Iterable[Closed]) -> tuple[bytes, bytes]:
    parts = list(parts)
    codes = np.concatenate([p.codes for p in parts])
    times = np.concatenate([p.times for p in parts])
    unique, where = np.unique(codes, return_inverse=True)
    return unique.tobytes(), np.bincount(where, times, len(unique)).astype(np.uint32).tobytes()


def _whole(text: str, a: Tokens, b: Tokens, writer: Writer) -> tuple:
    """The result of a text that is one range."""
    if text:
        tokens = stream(text, a, b)
        if tokens.good:
            size = int(tokens.ends[0][-1])
            one, inner = fragment(tokens, 0, size, 0, writer)
            first = writer.group(one.prefix)
            said = f"{first.text};{inner.text}" if one.groups else first.text
            return (one.n_a, one.n_b, one.groups + 1, hashlib.sha256(said.encode()).hexdigest(), *_sum_links([first, inner]))
    return 0, 0, 0, _NO_DIGEST, b"", b""


def _first_pass(docs: DataFrame, path_a: str, path_b: str, text: str, key: str, size: int) -> DataFrame:
    """Texts of one range are done; longer ones come back as segments, a row each."""
    schema = f"row long, {key} {docs.schema[key].dataType.simpleString()}, at long, segment string, {_DONE}"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        writer = Writer(a, b)
        number = TaskContext.get().partitionId() << 40

        def rows() -> Iterator[tuple]:
            nonlocal number
            for one, said in _rows(batches):
                said = said or ""
                number += 1
                # Bytes are counted only where characters leave it open.
                if len(said) * 4 <= size or len(said.encode()) <= size:
                    yield number, one, None, None, *_whole(said, a, b, writer)
                    continue
                at = 0
                for segment in segments(said, size):
                    yield number, one, at, segment, None, None, None, None, None, None
                    at += len(segment.encode()) + 1

        return _batches(rows(), fields)

    return docs.select(key, text).mapInArrow(task, schema)


def _leaf_row(row: int, at: int, part: int, one: Fragment, closed: Closed | None) -> tuple:
    links = (closed.codes.tobytes(), closed.times.tobytes()) if closed else (b"", b"")
    return (row, at, part, one.closes, one.at, *one.prefix, *one.suffix, one.groups, one.n_a, one.n_b, one.good,
            closed.text if closed else None, *links)


def _leaves(cut: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """Fragments of the byte ranges of every segment, numbered by the offset where they begin."""
    fields = arrow_schema(_LEAF)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        writer = Writer(a, b)

        def rows() -> Iterator[tuple]:
            for row, at, segment in _rows(batches, 4):
                tokens = stream(segment, a, b)
                total = len(segment.encode()) + 1
                if not tokens.good:
                    yield _leaf_row(row, at, 0, EMPTY._replace(good=False), None)
                    continue
                for low in range(0, total, size):
                    made = fragment(tokens, low, min(low + size, total), at + low, writer)
                    yield _leaf_row(row, at + low, 0, *made)

        return _batches(rows(), fields, 4)

    # A fixed number of tasks: by their bytes, segments would be gathered into fewer than their encoding is worth.
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.select("row", "at", "segment").repartition(tasks, "row", "at").mapInArrow(task, _LEAF)


_OPEN = ["row", "at", "closes", "first_at", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "groups", "n_a", "n_b", "good"]


def _composed(level: DataFrame, width: int, path_a: str, path_b: str) -> DataFrame:
    """Neighbouring fragments, those whose offsets share ``width`` bytes, as one; with the groups that this closes."""
    fields = arrow_schema(_LEAF)
    node = F.floor(F.col("at") / width).alias("node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(byte_level(path_a), pieces(path_b))

        def rows() -> Iterator[tuple]:
            for (row, _), some in groupby(_rows(batches), key=lambda r: r[:2]):
                total, at = EMPTY, None
                for _, _, here, closes, first, pa_, pb, sa, sb, groups, n_a, n_b, good in some:
                    at = here if at is None else at
                    y = Fragment(first, closes, (pa_, pb), (sa, sb), groups, n_a, n_b, good)
                    total, made = compose(total, y)
                    if made:
                        yield _leaf_row(row, y.at, 1, EMPTY, writer.group(made))
                yield _leaf_row(row, at, 0, total, None)

        return _batches(rows(), fields, 16)

    return (level.select("row", node, *_OPEN[1:]).repartition("row", "node").sortWithinPartitions("row", "node", "at")
            .mapInArrow(task, _LEAF))


def _tree(leaves: DataFrame, size: int, fan: int, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """The composed fragment of every document, and the groups closed on the way."""
    level, closed = leaves, []
    longest = leaves.agg(F.max("at")).first()[0]
    # The first level joins what begins in one range, the last one whole documents.
    width = size if longest is not None else None
    while width is not None:
        both = materialize(_composed(level, width, path_a, path_b), "align-level")
        closed.append(both.where("part = 1"))
        level = both.where("part = 0")
        width = width * fan if width <= longest else None
    seams = closed[0] if closed else leaves.limit(0)
    for more in closed[1:]:
        seams = seams.unionByName(more)
    return level, seams


def _root_groups(roots: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The first group of every document, which only its root closes."""
    fields = arrow_schema(_LEAF)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(byte_level(path_a), pieces(path_b))
        return _batches((_leaf_row(row, first, 1, EMPTY, writer.group((a, b))) for row, first, a, b in _rows(batches)), fields)

    return roots.where("good and closes").select("row", "first_at", "prefix_a", "prefix_b").mapInArrow(task, _LEAF)


def _digests(closed: DataFrame) -> DataFrame:
    """Digest of each document's groups, its closed texts read in order as a stream."""
    schema = "row long, groups_sha256 string"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row, some in groupby(_rows(batches, 8), key=lambda r: r[0]):
                digest, mark = hashlib.sha256(), ""
                for _, said in some:
                    digest.update(f"{mark}{said}".encode())
                    mark = ";"
                yield row, digest.hexdigest()

        return _batches(rows(), fields)

    # A group that ends in a range comes before the groups that begin in it.
    ordered = (closed.where("text <> ''").select("row", "at", F.col("part").alias("after"), "text")
               .repartition("row").sortWithinPartitions("row", "at", F.desc("after")))
    return ordered.select("row", "text").mapInArrow(task, schema)


class Aligned(NamedTuple):
    """What alignment leaves in the shared folder: short texts and all links, long texts' results."""
    rows: DataFrame
    links: DataFrame


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", key: str = "doc_id",
          size: int = RANGE, fan: int = FAN) -> Aligned:
    """``rows``: a result per document, ``row`` being its number; ``links``: pair codes and how often, by ``row``."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    first = materialize(_first_pass(docs, path_a, path_b, text, key, size), "align-first")
    short = first.where("segment IS NULL")
    cut = first.where("segment IS NOT NULL")
    leaves = materialize(_leaves(cut, path_a, path_b, size), "align-leaves")
    roots, seams = _tree(leaves, size, fan, path_a, path_b)
    closed = materialize(leaves.where("part = 0").unionByName(seams).unionByName(_root_groups(roots, path_a, path_b))
                         .join(roots.where("good").select("row"), "row", "left_semi").select("row", "at", "part", "text", "codes", "times"),
                         "align-closed")
    ids = cut.where("at = 0").select("row", key)
    long_rows = (ids.join(roots.select("row", "n_a", "n_b", "groups", "good"), "row")
                 .join(_digests(closed), "row", "left")
                 .select("row", key, *[F.when(F.col("good"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("n_a", "n_b")],
                         F.when(F.col("good"), F.col("groups") + 1).otherwise(0).cast("long").alias("n_groups"),
                         F.when(F.col("good"), F.col("groups_sha256")).otherwise(_NO_DIGEST).alias("groups_sha256")))
    rows = short.select("row", key, "n_a", "n_b", "n_groups", "groups_sha256").unionByName(long_rows)
    links = short.select("row", "codes", "times").unionByName(closed.select("row", "codes", "times")).where("codes <> X''")
    return Aligned(rows, links)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(code, n)`` of every linked pair of the corpus; a task adds up its own first."""
    schema = "code long, n long"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in slices(batches, 1024):
            parts = [codes, *(np.frombuffer(c, np.uint32) for c in batch.column(0).to_pylist())]
            times = [sums, *(np.frombuffer(t, np.uint32) for t in batch.column(1).to_pylist())]
            codes, where = np.unique(np.concatenate(parts), return_inverse=True)
            # Whole numbers below 2^53 stay exact.
            sums = np.bincount(where, np.concatenate(times), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(sums)], schema=fields)

    made = links.select("codes", "times").mapInArrow(task, schema)
    return made.groupBy("code").agg(F.sum("n").alias("n"))


def _link_sums(links: DataFrame, counts: DataFrame, pairs: int, bound: int) -> DataFrame:
    """Per row: links, those that are the best of their B id, and the sum of their counts."""
    # No more rows than pair_bound, which the vocabularies alone decide.
    table = counts.toArrow()
    if table.num_rows > bound:
        raise RuntimeError("more linked pairs than the vocabularies allow")
    codes, n = (table.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    best_of = np.zeros(pairs, np.int64)
    np.maximum.at(best_of, codes % pairs, n)
    shared = links.sparkSession.sparkContext.broadcast((codes, n, best_of[codes % pairs] == n))
    schema = "row long, n_links long, n_best long, count_sum long"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value

        def rows() -> Iterator[tuple]:
            for row, held, times in _rows(batches):
                at = np.searchsorted(codes, np.frombuffer(held, np.uint32))
                often = np.frombuffer(times, np.uint32).astype(np.int64)
                yield row, int(often.sum()), int(often[best[at]].sum()), int((often * n[at]).sum())

        return _batches(rows(), fields)

    sums = links.select("row", "codes", "times").mapInArrow(task, schema)
    return sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", key: str = "doc_id",
           size: int = RANGE, fan: int = FAN) -> DataFrame:
    """Tokens, groups, links and how common the links are, of every row."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    aligned = align(docs, path_a, path_b, text, key, size, fan)
    a, b = byte_level(path_a), pieces(path_b)
    sums = _link_sums(aligned.links, pair_counts(aligned.links), len(b.of_id), pair_bound(a, b))
    zero = F.lit(0).cast("long")
    return aligned.rows.join(sums, "row", "left").select(
        key, "n_a", "n_b", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")],
        "groups_sha256")
