"""Quality rules: compression ratios of whole texts and fixed chunks, held against bands by length.

A text is first written in an alphabet of its own, so that its script does not
count: its distinct characters are numbered in order of first occurrence, and
each is the byte of its number. Texts that differ by a mapping of letters are the same
bytes then. A text of more than ``ALPHABET`` distinct characters stays UTF-8. The ratio
is the Zstandard size over the size so written.

Short texts compress badly whatever they say, long ones better the longer they
are, so the limits depend on the length. A text is rejected when it as a whole lies under its
band (repetitive, told by the Zstandard size per character) or over it (incompressible, told by the ratio and the
bytes as written), or when more than half of its characters lie in chunks that do. Chunks are written in alphabets of their own.

Defined cases: a NULL text counts as the empty one; empty texts have ratio 1
and fail the word rule; repeated rows are judged alike, each row gives one row. A last chunk of less than
``LEAST_CHUNK`` characters is judged with the whole text only.
Every row is judged in the task that reads it, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import zstandard
from pyspark.sql import DataFrame

from firstpast.llm.common import filter_texts, per_text

MIN_WORDS = 50
# More than this part of the words in repeated three-word windows fails, in percent.
MAX_REPEATED = 50
LEVEL = 3
CHUNK = 4096
# A last chunk shorter than this is not judged by itself.
LEAST_CHUNK = 2048
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# So many characters have a byte each.
ALPHABET = 256

# (length from which the band holds, least size per character, greatest ratio)
BANDS = ((0, 0.0, 9.0), (64, 0.50, 1.30), (128, 0.42, 1.00), (256, 0.36, 0.85), (512, 0.30, 0.80),
         (1024, 0.27, 0.75), (4096, 0.24, 0.72), (16384, 0.21, 0.70), (65536, 0.18, 0.70))
CHUNK_BAND = (0.20, 0.72)

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, ratio double, repetitive_share double, incompressible_share double")


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    ratio: float
    repetitive_share: float
    incompressible_share: float


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            marked[i:i + 3] = b"\x01\x01\x01"
    return sum(marked)


def duplicate_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.split():
            seen.add(line)
    return repeated


def band(size: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if size >= start)


def rewritten(text: str) -> bytes:
    """The text in the alphabet of its characters in order of first occurrence, or UTF-8 if those are too many."""
    numbers = {ord(c): i for i, c in enumerate(dict.fromkeys(text))}
    return text.translate(numbers).encode("latin-1") if len(numbers) <= ALPHABET else text.encode()


def judge():
    """The function of one text, sharing one compressor per task."""
    compressor = zstandard.ZstdCompressor(level=LEVEL)

    def sizes(text: str) -> tuple[float, float, int]:
        """Zstandard size per character and per byte as written, and bytes as written."""
        if not text:
            return 1.0, 1.0, 0
        data = rewritten(text)
        size = len(compressor.compress(data))
        return size / len(text), size / len(data), len(data)

    def verdict(text: str) -> Verdict:
        data = text.encode()
        words = data.split()
        repeats = repeated_words(words)
        base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
        per_char, ratio, written = sizes(text)
        low, high = band(len(text))[0], band(written)[1]
        chunks = [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]
        judged = [(len(c), *((per_char, ratio) if len(chunks) == 1 else sizes(c)[:2])) for c in chunks if len(c) >= LEAST_CHUNK]
        total = max(1, sum(n for n, _, _ in judged))
        repetitive = sum(n for n, r, _ in judged if r < CHUNK_BAND[0]) / total
        incompressible = sum(n for n, _, r in judged if r > CHUNK_BAND[1]) / total
        kept = (not base_failed and per_char >= low and ratio <= high
                and repetitive <= 0.5 and incompressible <= 0.5)
        return Verdict(
            len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            duplicate_lines(data), repeats, base_failed, kept, ratio, repetitive, incompressible)

    return verdict


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The verdict on every row and the measures behind it."""
    return per_text(docs, f"{key} {docs.schema[key].dataType.simpleString()}, {COLUMNS}", judge, text, (key,))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns."""
    def make():
        verdict = judge()
        return lambda t: verdict(t).kept

    return filter_texts(docs, make, text)
