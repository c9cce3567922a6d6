"""Chat formatting: layouts by fingerprint, templates that can be undone, exact round trips."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from glosspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    """(conv_id, n_turns, digest, loss_chars, digest) by a plain walk."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, rows in by.items():
        own = "".join(t for *_, r, t in sorted(rows) if r == "assistant")
        out.append((conv, len(rows), digest("".join(f"{r}\n{t}\n" for *_, r, t in sorted(rows))), len(own), digest(own)))
    return collections.Counter(out)


def got(rows):
    return collections.Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows)


CONTROLS = [*chat.Template().controls, "\\", "\\\\", "<|", "|>", "[", "<", "\n", "é", "😀", "word "]


@pytest.mark.parametrize("part", [chat.PART, 40])
def test_round_trip(spark, part):
    rng = random.Random(11)
    say = lambda: "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "", None, say()]), rng.choice([say(), say(), None, ""])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(7, 1, "assistant", "again"), (7, 1, "assistant", "again"), (None, None, "user", "no id"), (50, None, "assistant", "first"), (50, 0, "assistant", "x" * 5000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = chat.formatted(table, part=part)
    assert got(chat.read_back(parts).collect()) == expected(rows)
    if part == 40:
        assert parts.groupBy("conv_id").count().where("count > 1").count() > 5
    for row in parts.collect():
        inside = row.formatted
        for control in chat.Template().others:
            assert control not in inside
        assert inside.count(chat.Template().open) == inside.count(chat.Template().close) == inside.count(chat.Template().middle)


def test_other_templates_and_tampered_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "<|im_end|> a \\"), (1, 1, "assistant", "b<s>")], SCHEMA)
    other = chat.Template("<|im_start|>", "<|sep|>", "<|im_end|>", ("<s>",))
    assert got(chat.read_back(chat.formatted(rows, other), other).collect()) == expected([tuple(r) for r in rows.collect()])
    broken = chat.formatted(rows, other).withColumn("formatted", F.concat("formatted", F.lit("more")))
    with pytest.raises(Exception, match="outside its turns"):
        chat.read_back(broken, other).collect()
    with pytest.raises(ValueError):
        chat.Template("<", "|", ">")


LAID_OUT = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, [("user", "q"), ("assistant", "a")]),
    ("messages", {"prompt": "q", "messages": [{"content": None, "role": "user"}]}, [("user", "")]),
    ("messages of parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "ab"), ("assistant", "c")]),
    ("conversations", {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": 5}]}, [("system", "s"), ("user", "q"), ("assistant", "a"), ("tool", "5")]),
    ("prompt and completion", {"prompt": "q", "completion": "a", "score": 0.5}, [("user", "q"), ("assistant", "a")]),
    ("instruction", {"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    ("question and answer", {"system": "", "question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ("turn row", {"turn": 4, "role": "user", "text": "t", "conv_id": 9}, [("user", "t")]),
]
REJECTED = ["{", "", "[]", "3", '{"prompt": "q"}', '{"prompt": {"a": 1}, "completion": "a"}', '{"turn": "x", "role": "u", "text": "t"}', '{"messages": "none"}', '{"messages": [{"role": "u", "content": "a"}, 3]}', "{}"]


def test_layouts(spark):
    rows = [(i, json.dumps(record)) for i, (_, record, _) in enumerate(LAID_OUT)] + [(100 + i, r) for i, r in enumerate(REJECTED)] + [(None, None)]
    found = chat.canonical(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    for i, (name, _, turns) in enumerate(LAID_OUT):
        mine = sorted((r.turn or 0, r.role, r.text) for r in found if r.conv_id == i)
        assert [t[1:] for t in mine] == turns and {r.layout for r in found if r.conv_id == i} == {name}
    rejects = [r for r in found if r.reject is not None]
    assert sorted(r.reject for r in rejects) == sorted([*REJECTED, ""])


def test_layouts_must_differ():
    twice = chat.Layout("twice", (chat.One("user", ("prompt",)),), ("prompt", "completion"))
    with pytest.raises(ValueError, match="cannot be told apart"):
        chat.Registry((*chat.LAYOUTS, twice))


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", 5, "y", "z")], SCHEMA + ", record long, layout string, part string")
    made = chat.read_back(chat.formatted(chat.canonical(chat.turn_records(rows)).where("reject IS NULL")))
    assert got(made.collect()) == expected([(1, 0, "user", "x")])
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.formatted(chat.canonical(chat.turn_records(empty)))).count() == 0
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "long " * 200_000) for i in range(8)], SCHEMA)
    parts = chat.formatted(long)
    assert parts.count() >= 4 and chat.read_back(parts).first().loss_chars == 4 * 1_000_000
