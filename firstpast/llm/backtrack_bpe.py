"""BPE with word ends: a backtracking encoder over longest matches, and an offset-table decoder.

An Aho-Corasick automaton over all tokens gives the longest token at every
position of a word. The encoder takes the longest one, checks it against the
token before it in a pair-compatibility table, and tries shorter tokens or
steps back where the pair could not come out of the merges. A position that was
left once is never entered again, so the work is linear in the word. Two tokens
are compatible if undoing their merges, latest first, meets no merge across their
border that would have come earlier; that is what makes the result exactly that
of the merges.

The vocabulary file names tokens, merges, special strings. Texts are cut at
special strings, then composed (NFC), lower-cased by character, and split into words.

Defined cases: NULL counts as the empty text, which has no ids and decodes to
the empty text; repeated rows are encoded one by one; every row is handled where it
is read, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import count

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from firstpast.llm.common import per_text

# Words of the vocabulary's splitting rule. Fixed values.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"
# A symbol that ends a word is told apart by its code point.
ENDED = 0x1000
# Letters and digits of scripts beyond these differ between editions of Unicode, so the library's own splitter is asked.
LATER_SCRIPTS = re.compile("[\u0530-\U0010ffff]")
# Words remembered per worker; frequent words come back at once after the table is emptied.
REMEMBERED = 400_000


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocabulary = said["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        # Symbols and merged tokens are numbered in the order in which merging makes them.
        form: dict[str, str] = {}
        for token in vocabulary:
            if len(token) == 1:
                form[token] = token
            elif len(token) == 1 + len(WORD_END) and token.endswith(WORD_END):
                form[token] = chr(ord(token[0]) + ENDED)
        number = dict(zip(form, count()))
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(number))]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in said["model"]["merges"]:
            token = left + right
            pair = number[left], number[right]
            if token not in number:
                number[token], form[token] = len(number), form[left] + form[right]
                self.parts.append(pair)
            self.joined.setdefault(pair, number[token])
        self.id_of = [vocabulary[token] for token in number]
        self.length = [len(form[token]) for token in number]
        self._index([form[token] for token in number])
        self._offsets(vocabulary)
        self.split = Tokenizer.from_file(path)
        self.allowed: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (chr(c) for c in count(256))
        self.byte_chars = {b: chr(b) if b in printable else next(rest) for b in range(256)}

    def _index(self, forms: list[str]) -> None:
        """The automaton, and for every token the longest shorter token that it starts with."""
        self.automaton = ahocorasick.Automaton()
        # A token is usable if merging its own text gives it: its parts must be what stands there before its merge.
        reached: list[bool] = []
        for i, (a, b) in enumerate(self.parts):
            reached.append(a == i or (reached[a] and reached[b] and self.compatible(a, b, i)))
        usable = {f: i for i, f in enumerate(forms) if reached[i]}
        for f, i in usable.items():
            self.automaton.add_word(f, (len(f), i))
        self.automaton.make_automaton()
        self.shorter = [next((usable[f[:k]] for k in range(len(f) - 1, 0, -1) if f[:k] in usable), -1) for f in forms]

    def _offsets(self, vocabulary: dict[str, int]) -> None:
        """All token texts end to end, each with a space behind it, and where each begins."""
        texts = {i: t for t, i in (vocabulary | self.special).items()}
        pieces = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether merging would leave these two tokens side by side (by merges before ``limit``)."""
        # The latest merge that could still join something over the border.
        limit = len(self.parts) if limit is None else limit
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            whole_left, whole_right = self.parts[left][1] == left, self.parts[right][0] == right
            if whole_left and whole_right:
                return True
            # Undo the later of the two merges. What the right one does comes after an equal left one.
            if not whole_left and (whole_right or left > right):
                limit, left = min(limit, left), self.parts[left][1]
            else:
                limit, right = min(limit, right + 1), self.parts[right][0]

    def _pair(self, left: int, right: int) -> bool:
        known = self.allowed.get((left, right))
        if known is None:
            if len(self.allowed) >= REMEMBERED:
                self.allowed.clear()
            known = self.allowed[left, right] = self.compatible(left, right)
        return known

    def merged(self, symbols: str) -> list[int]:
        """Token numbers of one word's symbols."""
        longest = [0] * len(symbols)
        for end, (length, token) in self.automaton.iter(symbols):
            longest[end - length + 1] = token  # later ends are longer tokens
        left = bytearray(len(symbols) + 1)  # positions that were given up
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(symbols):
            end = at + self.length[token]
            if not left[end] and (not out or self._pair(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(symbols) else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                left[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def word(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.ids("".join(map(self.byte_chars.__getitem__, word.encode())))
        return found

    def ids(self, symbols: str) -> list[int]:
        return [self.id_of[t] for t in self.merged(symbols[:-1] + chr(ord(symbols[-1]) + ENDED))]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)):
            if k % 2:
                ids.append(self.special[part])
            elif not part.isascii() and LATER_SCRIPTS.search(part):
                for symbols, _ in self.split.pre_tokenizer.pre_tokenize_str(self.split.normalizer.normalize_str(part)):
                    ids += self.ids(symbols)
            else:
                # Lower-casing a whole text would treat a final sigma by its place.
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                for word in WORDS.findall(part.lower()):
                    ids += self.word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The token texts, a space between them."""
        if not len(ids):
            return ""
        ids = np.asarray(ids)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.bytes[places[:-1]].tobytes().decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` of every text."""
    path = path or vocabulary_path()
    return per_text(docs, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>",
                    lambda: lambda t: (codec(path).encode(t),), text, (key,))


def digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the number of ids, and digests of the ids and of the text they decode to."""
    path = path or vocabulary_path()

    def make():
        one = codec(path)
        decimal = [str(i) for i in range(len(one.offsets))]

        def digest(t: str) -> tuple:
            ids = one.encode(t)
            said = " ".join(map(decimal.__getitem__, ids))
            return (len(ids), hashlib.sha256(said.encode()).hexdigest(),
                    hashlib.sha256(one.decode(ids).encode()).hexdigest())

        return digest

    return per_text(docs, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, "
                          "decoded_sha256 string", make, text, (key,))
