"""Round trips, layouts, digests by brute force, odd inputs."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firstpast.llm import schema_chat as chat
from firstpast.llm.queries import CHECKS, QUERIES

TEXT = st.lists(st.sampled_from([*"<|>[]/\\ISNTYs%end\n é", "<|", "<|end|>", "[INST]", "</s>", "<<SYS>>"]), max_size=12).map("".join)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.tuples(TEXT | st.sampled_from(["user", "assistant"]), TEXT), max_size=4))
def test_round_trip(turns):
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_no_control_string_is_left_in_a_text(text):
    held = chat.escape(text)
    assert not any(c in held for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>"))
    assert chat.unescape(held) == text


RECORDS = [
    ({"prompt": "p", "completion": "c"}, "prompt, completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction, input", [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "id": 3}, "instruction, input", [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "u"}]}]}, "messages",
     [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}, "conversations",
     [("user", "h"), ("assistant", "")]),
    ({"data": {"prompt": "p", "completion": "c"}}, "nested data", [("user", "p"), ("assistant", "c")]),
    ({"other": 1}, None, []),
]


def test_layouts(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "no json"), (92, "[1]")]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id long, record string"), "record", "id").collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k].layout == layout and [(t.role, t.text) for t in got[k].turns] == turns
    assert all(got[k].turns == [] and got[k].schema_print is None for k in (90, 91, 92))
    assert got[6].schema_print is not None
    turns = chat.as_turns(chat.canonical(spark.createDataFrame(rows, "id long, record string"), "record", "id"), "id")
    assert turns.count() == sum(len(t) for _, _, t in RECORDS)


FULL = [
    ({"system": "s", "messages": [{"role": "user", "content": "u"}]}, [("system", "s"), ("user", "u")], []),
    ({"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")], []),
    ({"system": "s", "instruction": "i", "output": "o"}, [("system", "s"), ("user", "i"), ("assistant", "o")], []),
    ({"instruction": "i", "output": "o", "history": [["q", "a"], ["r", "b"]]},
     [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b"), ("user", "i"), ("assistant", "o")], []),
    ({"system": "s", "instruction": "i", "input": "x", "output": "o", "history": [["q", "a"]]},
     [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "i"), ("user", "x"), ("assistant", "o")], []),
    ({"instruction": "i", "output": "o", "history": []}, [("user", "i"), ("assistant", "o")], []),
    ({"prompt": "p", "completion": "c", "preamble": "z"}, [("user", "p"), ("assistant", "c")], ["preamble"]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}]}, {"role": "assistant", "content": "a"}]},
     [("user", "u"), ("assistant", "a")], ["messages[].content[].type"]),
]


def test_nothing_of_a_record_is_lost_unnamed(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(FULL)]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id long, record string"), "record", "id").collect()}
    for k, (_, turns, unmapped) in enumerate(FULL):
        assert [(t.role, t.text) for t in got[k].turns] == turns and got[k].unmapped == unmapped, k


def test_fingerprints_see_paths_not_values():
    a = {"x": {"y": 1}, "z": [{"t": "a"}, {"u": 2}]}
    b = {"z": [{"u": 9, "t": "b"}], "x": {"y": "other"}}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b))
    assert chat.fingerprint(chat.paths(a)) != chat.fingerprint(chat.paths({"x": 1}))


def brute(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, turns in out.items():
        said = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        want[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss),
                      hashlib.sha256(loss.encode()).hexdigest(), len(chat.formatted(said)[0]))
    return want


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op9_schema_chat"](spark, sf_dir).collect()}
    assert got == brute(rows)


def test_conversations_by_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = con.execute(CHECKS["op9_schema_chat"])
    names = [d[0] for d in cursor.description]
    rows = QUERIES["op9_schema_chat"](spark, sf_dir).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(cursor.fetchall())


def test_texts_and_masks(spark, sf_dir):
    turns = chat.turn_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    digest = {r.conv_id: r for r in chat.digests(turns).collect()}
    for r in chat.chat_texts(turns).collect():
        loss = "".join(chat.unescape(r.formatted[s.start:s.end]) for s in r.loss)
        d = digest[r.conv_id]
        assert (len(r.formatted), len(chat.parsed(r.formatted)), len(loss)) == (d.formatted_chars, d.n_turns, d.loss_chars)
        assert hashlib.sha256(loss.encode()).hexdigest() == d.loss_sha256


def test_odd_inputs(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 2, "assistant", ""), (None, 5, "user", "x"),
            (None, 4, "assistant", "y" * 300_000), (2, 1, "we|ird%7C", "<|end|>"), *[(3, k % 7, "assistant", f"t{k}") for k in range(2000)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = table.select("*", *[F.lit("x").alias(c) for c in ("formatted", "loss", "position", "author")]).repartition(4)
    assert {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.turn_table(wide)).collect()} == brute(rows)
    assert chat.digests(chat.turn_table(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.turn_table(table.drop("role"))


@pytest.mark.parametrize("piece", [1, 2, 7, 8, 100, 1 << 16])
def test_turns_are_read_back_from_the_running_text(piece):
    """Pieces end anywhere: in marks, in escapes, in texts; what comes back and what is learned is the same."""
    said = [("user", "a <|end|> b </s>"), ("assistant", "x" * 300 + "[INST]"), ("", ""), ("a|b%", "<|user|>\\<|"), ("assistant", ""),
            ("assistant", "[/INST] <\\|end|>"), ("system", "<|end|")]
    back = list(chat.read_back(said, piece))
    assert [turn for turn, _, _ in back] == said
    assert [t for _, learned, _ in back for t in learned] == [t for role, t in said if role == "assistant"]
    assert back[-1][2] == len(chat.formatted(said)[0])


def test_a_broken_text_is_not_read():
    for text in ("<|user|>a", "x<|user|>a<|end|>", "<|user|>a<|end|>rest"):
        reader = chat.ReadBack()
        with pytest.raises(ValueError):
            list(reader.feed(text))
            reader.close()


def test_the_query_selects_its_mapping_by_fingerprint(spark, sf_dir, monkeypatch):
    asked = []
    mark = chat.fingerprint
    monkeypatch.setattr(chat, "fingerprint", lambda found: (asked.append(found), mark(found))[1])
    QUERIES["op9_schema_chat"](spark, sf_dir)
    assert asked == [{"conv_id", "turn", "role", "text"}]
    monkeypatch.setattr(chat, "TURN_TABLES", {})
    with pytest.raises(ValueError):
        QUERIES["op9_schema_chat"](spark, sf_dir)
