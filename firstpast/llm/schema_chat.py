"""Chat formatting: a record's schema fingerprint selects the mapping that gives its turns.

Conversations come as prompts with completions, instructions with outputs, message
lists under several names, or tables of turns. The nested field paths of a record, with kinds
of values but without the values, are hashed; the fingerprint selects a declarative mapping:
a list of (role, path), or where the messages lie and what their fields and roles are called. A
fingerprint that no mapping names falls back to the mapping whose paths it holds, which names the paths
that it leaves out, and a
record that none fits gives no turns but keeps its row, with its fingerprint to be mapped.

Turns become one text per conversation. Every turn is ``<|role|>``, its text and ``<|end|>``. Control strings
inside a text, those of this template and of common others, get a backslash after their first character, and
one more where some are there already, which can be undone exactly. The loss mask covers each assistant
text once, in characters of the formatted text.

Defined cases: NULL texts and roles are empty; turns go by number, then role, then text, NULL numbers first;
repeated rows are turns of their own; rows with a NULL id are one conversation; an empty table gives no rows.
Spark sorts the turns and a task reads them as a stream: ``chat_texts`` holds the text of one conversation, which is one value of its
result. Digests read a conversation's running text back in pieces of ``PIECE`` characters that know nothing of turns, and hold no more
than one turn and a piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched, groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from firstpast.llm.common import arrow_schema, slices

Turn = tuple[str, str]
# Characters of a conversation's text that are read back at once.
PIECE = 1 << 16


# -- schema fingerprints -----------------------------------------------------------

def paths(value: Any, at: str = "") -> set[str]:
    """The field paths of a record: names joined by dots, ``[]`` for the items of a list."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({at + "[]"}, *(paths(v, at + "[]") for v in value))
    return {at}


def type_paths(kind: DataType, at: str = "") -> set[str]:
    """The same for a column type."""
    if isinstance(kind, StructType):
        return set().union(*(type_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind))
    if isinstance(kind, ArrayType):
        return {at + "[]"} | type_paths(kind.elementType, at + "[]")
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


class Mapping(NamedTuple):
    """How a layout gives turns: fixed turns, or a list of messages, after fixed ones or alone.

    A list of earlier pairs of user and assistant comes after the system's turn.
    """

    name: str
    turns: tuple[Turn, ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    history: str = ""

    def needs(self) -> set[str]:
        listed = {f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"} if self.messages else set()
        return {p for _, p in self.turns} | listed | ({self.history + "[]"} if self.history else set())

    def leaves(self, found: set[str]) -> list[str]:
        """The paths that none of the turns is made from."""
        said = {p for _, p in self.turns} | ({f"{self.messages}[].{self.text}"} if self.messages else set())
        taken = self.needs() | {p + more for p in said for more in ("[]", "[].text")}
        taken |= {self.messages + "[]"} if self.messages else set()
        return sorted(found - taken - ({self.history + "[][]"} if self.history else set()))

    def apply(self, record: dict) -> list[Turn]:
        made = [(role, said) for role, path in self.turns if (said := reach(record, path)) not in (None, "")]
        earlier = reach(record, self.history) if self.history else None
        pairs = [(role, said) for pair in earlier or [] if isinstance(pair, list)
                 for role, said in zip(("user", "assistant") * len(pair), pair) if said not in (None, "")]
        after = sum(role == "system" for role, _ in made)
        made[after:after] = pairs
        for message in (reach(record, self.messages) or []) if self.messages else ():
            made.append((ROLES.get(str(message.get(self.role)).lower(), str(message.get(self.role) or "user")),
                         as_text(message.get(self.text))))
        return [(role, as_text(said)) for role, said in made]


def reach(record: Any, path: str) -> Any:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def as_text(value: Any) -> str:
    """A text; the texts of a list of parts; nothing for NULL."""
    if isinstance(value, list):
        return "".join(as_text(p.get("text") if isinstance(p, dict) else p) for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant",
         "bot": "assistant", "model": "assistant", "system": "system", "tool": "tool", "function": "tool"}

# Layouts, those that need more paths first.
_PLAIN = (
    Mapping("instruction with input", (("system", "system"), ("user", "instruction"), ("user", "input"),
                                       ("assistant", "output"))),
    Mapping("instruction, input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction, response", (("user", "instruction"), ("user", "context"), ("assistant", "response"))),
    Mapping("system with conversations", (("system", "system"),), "conversations", "from", "value"),
    Mapping("instruction", (("user", "instruction"), ("assistant", "output"))),
    Mapping("conversations", (), "conversations", "from", "value"),
    Mapping("messages", (), "messages"),
    Mapping("conversation", (), "conversation"),
    Mapping("turns", (), "turns", "role", "text"),
    Mapping("prompt, completion", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt, response", (("user", "prompt"), ("assistant", "response"))),
    Mapping("question, answer", (("user", "question"), ("assistant", "answer"))),
    Mapping("nested data", (("user", "data.prompt"), ("assistant", "data.completion"))),
)
# Each layout also with a system text, and those of instructions with earlier turns.
_SYSTEM = tuple(m._replace(name=f"{m.name}, system", turns=(("system", "system"), *m.turns))
                for m in _PLAIN if ("system", "system") not in m.turns and m.name != "conversations")
_HISTORY = tuple(m._replace(name=f"{m.name}, history", history="history")
                 for m in (*_PLAIN, *_SYSTEM) if ("user", "instruction") in m.turns)
MAPPINGS = tuple(sorted((*_PLAIN, *_SYSTEM, *_HISTORY), key=lambda m: -len(m.needs())))
# Layouts of tables with a row per turn, by the fingerprint of their columns: (conversation, order, role, text).
_TURN_COLUMNS = (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "author", "content"))
TURN_TABLES = {fingerprint(set(columns)): columns for columns in _TURN_COLUMNS}


class Selector:
    """The mapping of a fingerprint, remembered: records of one source mostly share theirs."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.by_print = {fingerprint(m.needs() | ({m.messages + "[]"} if m.messages else set())): m for m in mappings}

    def __call__(self, record: Any) -> tuple[str, Mapping | None]:
        found = paths(record)
        mark = fingerprint(found)
        if mark not in self.by_print:
            if len(self.by_print) > 10_000:
                self.by_print = {}
            self.by_print[mark] = next((m for m in self.mappings if m.needs() <= found), None)
        return mark, self.by_print[mark]


# -- the template -------------------------------------------------------------------

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
# The first character of a control string, and the backslashes behind it.
_BARE = re.compile(r"([<\[])(?=\\*(?:\||/?INST\]|/?s>|</?SYS>>))")
_ESCAPED = re.compile(r"([<\[])\\(?=\\*(?:\||/?INST\]|/?s>|</?SYS>>))")
_TURN = re.compile(r"<\|([^|]*)\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return OPEN + role.replace("%", "%25").replace("|", "%7C") + CLOSE


def formatted(turns: Iterable[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and where its assistant texts stand in it."""
    out, at, mask = [], 0, []
    for role, said in turns:
        opening, body = head(role), escape(said)
        if role == "assistant":
            mask.append((at + len(opening), at + len(opening) + len(body)))
        out += [opening, body, END]
        at += len(opening) + len(body) + len(END)
    return "".join(out), mask


def parsed(text: str) -> list[Turn]:
    """The turns of a formatted text."""
    return [(m[1].replace("%7C", "|").replace("%25", "%"), unescape(m[2])) for m in _TURN.finditer(text)]


class ReadBack:
    """Reads the running text of a conversation piece by piece: its turns, and what stands under its loss mask."""

    def __init__(self) -> None:
        self.held, self.start, self.scanned = "", 0, 0
        self.spans: deque[tuple[int, int]] = deque()

    def feed(self, piece: str) -> Iterator[tuple[Turn, list[str]]]:
        """The turns that end in the piece, each with the unescaped texts of the spans up to its end."""
        self.held += piece
        at = 0
        while (end := self.held.find(END, max(at, self.scanned))) >= 0:
            end += len(END)
            found = _TURN.fullmatch(self.held, at, end)
            if found is None:
                raise ValueError(f"no turn in characters {self.start + at} to {self.start + end}")
            learned = []
            while self.spans and self.spans[0][1] <= self.start + end:
                first, stop = self.spans.popleft()
                if first < self.start + at:
                    raise ValueError(f"the mask from {first} reaches over a turn")
                learned.append(unescape(self.held[first - self.start:stop - self.start]))
            yield (found[1].replace("%7C", "|").replace("%25", "%"), unescape(found[2])), learned
            at = end
        # An end mark may lie across the border of two pieces.
        self.held, self.start = self.held[at:], self.start + at
        self.scanned = max(0, len(self.held) - len(END) + 1)

    def close(self) -> None:
        if self.held or self.spans:
            raise ValueError("text or mask behind the last turn")


def read_back(said: Iterable[Turn], piece: int) -> Iterator[tuple[Turn, list[str], int]]:
    """Turns formatted as one text and read back from it, with what is learned of them and the characters written so far."""
    reader, waiting, written = ReadBack(), "", 0
    for turn in said:
        text, mask = formatted([turn])
        reader.spans.extend((a + written, b + written) for a, b in mask)
        written += len(text)
        waiting += text
        if len(waiting) >= piece:
            whole = len(waiting) - len(waiting) % piece
            for k in range(0, whole, piece):
                for back, learned in reader.feed(waiting[k:k + piece]):
                    yield back, learned, written
            waiting = waiting[whole:]
    for back, learned in reader.feed(waiting):
        yield back, learned, written
    reader.close()


# -- jobs ------------------------------------------------------------------------------

def canonical(records: DataFrame, column: str, key: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``key``, ``schema_print``, ``layout``, ``turns`` and ``unmapped`` of records in JSON text.

    What is no record has no layout. ``unmapped`` are the paths that no turn is made from.
    """
    schema = (f"{key} {records.schema[key].dataType.simpleString()}, schema_print string, layout string, "
              "turns array<struct<role:string,text:string>>, unmapped array<string>")
    fields = arrow_schema(schema)

    def one(text: str | None, select: Selector) -> tuple:
        try:
            record = json.loads(text or "null")
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, [], []
        mark, mapping = select(record)
        if mapping is None:
            return mark, None, [], sorted(paths(record))
        turns = [{"role": r, "text": t} for r, t in mapping.apply(record)]
        return mark, mapping.name, turns, mapping.leaves(paths(record))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = Selector(mappings)
        for batch in slices(batches):
            made = zip(*(one(t, select) for t in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(made, list(fields)[1:]))], schema=fields)

    return records.select(key, column).mapInArrow(task, schema)


def as_turns(records: DataFrame, key: str) -> DataFrame:
    """Canonical records as a table of turns, one row per turn."""
    return records.select(key, F.posexplode("turns").alias("turn", "said")).select(
        F.col(key).alias("conv_id"), "turn", "said.role", "said.text")


def turn_table(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table of turns; the fingerprint of its schema selects which columns they are.

    A fingerprint that names no layout falls back to the layout whose paths the schema holds, as for records.
    """
    found = type_paths(rows.schema)
    names = TURN_TABLES.get(fingerprint(found)) or next((c for c in TURN_TABLES.values() if set(c) <= found), None)
    if names is None:
        raise ValueError(f"no mapping for a table of {sorted(found)}")
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, ("conv_id", "turn", "role", "text"))])


def _streams(turns: DataFrame) -> DataFrame:
    """Turns of a conversation next to each other and in order."""
    text = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return text.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[Turn]]]:
    """Each id with its turns; sorted rows of a conversation may lie in several batches."""
    rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
    for one, turns in groupby(rows, key=lambda row: row[0]):
        yield one, ((role, text) for _, role, text in turns)


def _written(made: Iterable[tuple], fields: pa.Schema, rows: int) -> Iterator[pa.RecordBatch]:
    for some in batched(made, rows):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some), fields)], schema=fields)


def chat_texts(turns: DataFrame) -> DataFrame:
    """``conv_id``, the formatted text, and the loss mask as spans of it."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, formatted string, loss array<struct<start:long,end:long>>"
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for one, said in _conversations(batches):
                text, mask = formatted(said)
                yield one, text, [{"start": a, "end": b} for a, b in mask]

        return _written(rows(), fields, 64)

    return _streams(turns).mapInArrow(task, schema)


def digests(turns: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when it is read back, as counts and digests."""
    schema = (f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
              "loss_chars long, loss_sha256 string, formatted_chars long")
    fields = arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for one, said in _conversations(batches):
                every, loss = hashlib.sha256(), hashlib.sha256()
                n = masked = chars = 0
                for (role, back), learned, chars in read_back(said, PIECE):
                    n += 1
                    every.update(f"{role}\n{back}\n".encode())
                    for text in learned:
                        masked += len(text)
                        loss.update(text.encode())
                yield one, n, every.hexdigest(), masked, loss.hexdigest(), chars

        return _written(rows(), fields, 1024)

    return _streams(turns).mapInArrow(task, schema)
