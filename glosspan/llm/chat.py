"""Chat formatting: records of any known layout become canonical turns, and these one marked text a conversation.

A record is a JSON object.  Its nested field paths (``messages[].role``), those
that no layout knows left aside, are hashed to a fingerprint; a registry maps
fingerprints to declarative layouts, which say where turns, roles and texts lie.
A layout with optional paths is entered under the fingerprint of every choice
of them.  Records are read one at a time where they lie, so nested conversations
and tables with a row for each turn go the same way; records without a layout
are kept apart with the reason, never dropped.

The template writes open, role, separator, text, close for a turn.  Inside roles
and texts a backslash is doubled and one is put after the first character of
every control string, also of those other templates use, so no text can end a
turn or open one, and the change can be undone.  The loss mask is a list of
ranges of code points, one for the text of each assistant turn.

A conversation is written in parts that end between turns, of about PART code
points, so the longest conversation needs no more memory than one turn; nearly
all have one part.  Running lengths and digests pass over a conversation in
order, which one task does for each conversation in constant memory (a digest
of a whole cannot be made from pieces).

Defined results: a null text or role is empty; turns are ordered by turn (nulls
first), then role, then text, so repeated rows are turns of their own; a null
conv_id is one more conversation; a conversation in several records is the union
of their turns; malformed JSON, other types in a field and unknown layouts are
rejects; an empty table gives an empty result; further columns of a table are
further fields of its records and are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.llm.common import table

#: Code points of a conversation's text that are kept in one row.
PART = 1 << 20


@dataclass(frozen=True)
class One:
    """A turn of a fixed role made of some fields of the record, joined; without any of them there is no turn."""

    role: str
    fields: tuple[str, ...]
    join: str = "\n\n"


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list; the text may itself be a list of parts with a text field."""

    items: str
    role: str
    text: str
    part: str | None = None


@dataclass(frozen=True)
class Row:
    """The record is one turn of a longer conversation."""

    order: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """Paths that must be there, paths that may be, and the turns, in order."""

    name: str
    turns: tuple[One | Each | Row, ...]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "prompter": "user"}

LAYOUTS = (
    Layout("turn row", (Row("turn", "role", "text"),), ("turn", "role", "text")),
    Layout("messages", (Each("messages", "role", "content"),), ("messages[].role", "messages[].content"), ("prompt",)),
    Layout("messages of parts", (Each("messages", "role", "content", "text"),), ("messages[].role", "messages[].content[].text"), ("messages[].content", "messages[].content[].type", "prompt")),
    Layout("conversations", (One("system", ("system",)), Each("conversations", "from", "value")), ("conversations[].from", "conversations[].value"), ("system",), SPOKEN),
    Layout("prompt and completion", (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",))), ("prompt", "completion"), ("system",)),
    Layout("prompt and response", (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",))), ("prompt", "response"), ("system",)),
    Layout("instruction", (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))), ("instruction", "output"), ("input", "system")),
    Layout("instruction and response", (One("user", ("instruction", "context")), One("assistant", ("response",))), ("instruction", "response"), ("context",)),
    Layout("question and answer", (One("system", ("system",)), One("user", ("question",)), One("assistant", ("answer",))), ("question", "answer"), ("system",)),
)


def paths(value: object, known: frozenset[str], at: str = "") -> set[str]:
    """The nested field paths of a JSON value that are known."""
    found: set[str] = set()
    if isinstance(value, dict):
        for name, inner in value.items():
            path = f"{at}.{name}" if at else name
            if isinstance(inner, dict | list):
                found |= paths(inner, known, path)
            elif path in known:
                found.add(path)
    elif isinstance(value, list):
        for inner in value:
            if isinstance(inner, dict | list):
                found |= paths(inner, known, f"{at}[]")
            elif f"{at}[]" in known:
                found.add(f"{at}[]")
    return found


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


class Registry:
    """Fingerprints and their layouts; two layouts must not share one."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known = frozenset(p for layout in layouts for p in (*layout.needs, *layout.may))
        self.by: dict[str, Layout] = {}
        for layout in layouts:
            for n in range(len(layout.may) + 1):
                for chosen in itertools.combinations(layout.may, n):
                    key = fingerprint({*layout.needs, *chosen})
                    if key in self.by:
                        raise ValueError(f"{layout.name} and {self.by[key].name} cannot be told apart by their fields")
                    self.by[key] = layout


def _text(value: object) -> str:
    if isinstance(value, dict | list):
        raise TypeError("a text is nested")
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of a record by its layout."""
    out: list[tuple[int | None, str, str]] = []
    for rule in layout.turns:
        if isinstance(rule, Row):
            turn = record[rule.order]
            if not isinstance(turn, int | None) or isinstance(turn, bool):
                raise TypeError("a turn is no whole number")
            out.append((turn, _text(record[rule.role]), _text(record[rule.text])))
        elif isinstance(rule, One):
            texts = [_text(record[f]) for f in rule.fields if record.get(f) not in (None, "")]
            if texts or rule.fields[0] in layout.needs:
                out.append((len(out), rule.role, rule.join.join(texts)))
        else:
            for item in record[rule.items]:
                text = item.get(rule.text)
                if rule.part and isinstance(text, list):
                    text = "".join(_text(p.get(rule.part)) for p in text)
                role = _text(item.get(rule.role))
                out.append((len(out), layout.roles.get(role.lower(), role), _text(text)))
    return out


CANONICAL = "conv_id long, layout string, turn long, role string, text string, reject string"


def canonical(records: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Turns of (conv_id, record): conv_id, layout, turn, role, text; in ``reject`` the record of one that has none."""
    registry = registry or Registry()

    def read(source: str | None) -> tuple[str, list[tuple[int | None, str, str]]]:
        record = json.loads(source or "")
        layout = registry.by[fingerprint(paths(record, registry.known))]
        return layout.name, turns_of(record, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    name, turns = read(source)
                    rows += [(conv, name, *t, None) for t in turns]
                except (ValueError, KeyError, TypeError, AttributeError):
                    rows.append((conv, None, None, None, None, source or ""))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "layout", "turn", "role", "text", "reject"])

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(run, CANONICAL)


def turn_records(rows: DataFrame) -> DataFrame:
    """A table with a row for each turn as records of one turn."""
    return rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


@dataclass(frozen=True)
class Template:
    """What marks turns, and further control strings that no text may hold bare."""

    open: str = "<|start|>"
    middle: str = "<|message|>"
    close: str = "<|end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>")

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("a control string has two characters at least and no backslash")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.others)

    def escaped(self, text: Column) -> Column:
        begins = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?s)(?=(?:{begins}))(.)", "$1\\\\")


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def formatted(turns: DataFrame, template: Template | None = None, part: int = PART) -> DataFrame:
    """Parts of conversations: conv_id, part, formatted, loss (ranges of code points under the mask).

    All parts of a conversation lie in one partition.
    """
    template = template or Template()
    head = F.concat(F.lit(template.open), template.escaped(F.coalesce("role", F.lit(""))), F.lit(template.middle))
    body = template.escaped(F.coalesce("text", F.lit("")))
    pieces = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    pieces = pieces.select("*", head.alias("head"), body.alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(template.close)
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    pieces = pieces.select("conv_id", "role", "head", "body", F.row_number().over(order).alias("place"), F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    turn = F.struct("place", F.concat("head", "body", F.lit(template.close)).alias("text"), (F.col("begin") + F.char_length("head")).alias("a"), F.char_length("body").alias("n"), (F.col("role") == "assistant").alias("own"))
    parts = pieces.groupBy("conv_id", F.floor(F.col("begin") / part).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.min("begin").alias("base"))
    own = F.transform(F.filter("turns", lambda t: t["own"]), lambda t: F.struct((t["a"] - F.col("base")).alias("begin"), (t["a"] - F.col("base") + t["n"]).alias("end")))
    return parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), own.alias("loss"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """What :func:`formatted` wrote, read from the texts and masks alone: counts and digests for each conversation."""
    template = template or Template()
    turn = re.compile(f"(?s){re.escape(template.open)}(.*?){re.escape(template.middle)}(.*?){re.escape(template.close)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def told(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*((r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows), strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for found in turn.finditer(text):
                    if found.start() != at:
                        raise ValueError(f"conversation {conv} has text outside its turns")
                    at = found.end()
                    now[1] += 1
                    now[2].update(f"{unescaped(found[1])}\n{unescaped(found[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv} has text outside its turns")
                for span in loss:
                    own = unescaped(text[span["begin"] : span["end"]])
                    now[3] += len(own)
                    now[4].update(own.encode())
                now[5] += len(text)
            yield told(done)
        if now:
            yield told([now])

    # The parts of a conversation already share a partition; only their order is missing.
    return parts.sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss").mapInArrow(run, READ)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one, numbered -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    tricky = json.dumps({"conversations": [{"from": "human", "value": said}, {"from": "gpt", "value": said}]})
    records = turn_records(table(spark, sf_dir, "conversations")).unionByName(spark.createDataFrame([(-1, tricky)], "conv_id long, record string"))
    return read_back(formatted(canonical(records).where("reject IS NULL")))


def oracle(template: Template | None = None) -> str:
    template = template or Template()
    controls = "|".join(re.escape(c) for c in template.controls)
    marks = len(template.open) + len(template.middle) + len(template.close)
    escaped = lambda x: rf"(length({x}) + length({x}) - length(replace({x}, '\', '')) + len(regexp_extract_all({x}, '{controls}')))"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({marks} + {escaped("role")} + {escaped("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


QUERIES = {"op11_chat": op11_chat}
ORACLES = {"op11_chat": oracle()}
