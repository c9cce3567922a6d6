"""Grounded answers: passages, budgets, citations, costs, comparison, chat."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.functions.text import citation

CACHE_WRITE_FACTOR = 1.25
NOTHING_FOUND = "No indexed passage answers this question."
LENGTHS = {"short": "Answer in two or three sentences.", "medium": "", "long": "Answer in detail, in several paragraphs."}


def numbered(passages: DataFrame) -> DataFrame:
    """Adds ``block``: ``[n] (source: citation)`` and the text, for rows with rank and chunk columns."""
    return passages.withColumn("block", F.concat(F.lit("["), F.col("rank"), F.lit("] (source: "), citation(), F.lit(")\n"), F.col("text")))


def context(passages: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, context): the blocks in rank order between context tags."""
    rows = numbered(passages).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("all"))
    return rows.select(key, F.concat(F.lit("<context>\n"), F.array_join(F.transform("all", lambda b: b["block"]), "\n\n"), F.lit("\n</context>")).alias("context"))


def prompt(question: str, context_column: str | Column = "context") -> Column:
    body = F.col(context_column) if isinstance(context_column, str) else context_column
    return F.concat(body, F.lit(f"\n\nQuestion: {question}"))


def system_prompt(language: str = "", length: str = "medium", chat: bool = False) -> str:
    if length not in LENGTHS:
        raise ValueError(f"length must be one of {', '.join(LENGTHS)}")
    parts = [
        "Answer from the numbered passages only and cite them as [n].",
        f"Answer in {language}, whatever the language of the question." if language else "Answer in the language of the question.",
        LENGTHS[length],
        "Earlier turns of the conversation give the question its meaning." if chat else "",
    ]
    return " ".join(p for p in parts if p)


def budgeted(passages: DataFrame, budget: int, key: str = "source", order: str = "position") -> DataFrame:
    """The leading passages of each key whose texts fit the budget; the first always stays.

    The cut is at the first passage that would exceed it, so a short passage
    behind a long one doesn't slip in.  Adds n and omitted (per key).
    """
    by = W.partitionBy(key).orderBy(order)
    running = F.sum(F.char_length("text")).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = passages.withColumn("n", F.row_number().over(by)).withColumn("used", running)
    over = F.max(F.col("used") > budget).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("keep", (F.col("n") == 1) | ~over)
    omitted = F.sum(F.when(F.col("keep"), 0).otherwise(1)).over(W.partitionBy(key))
    return rows.withColumn("omitted", omitted).where("keep").drop("keep")


def cited_documents(results: DataFrame) -> DataFrame:
    """Results (rank, source, indexed_at) by document: newest first, then best rank."""
    by = results.groupBy("source").agg(F.max("indexed_at").alias("indexed_at"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    return by.orderBy(F.desc("indexed_at"), "best_rank")


def overlap(left: str | Column, right: str | Column) -> Column:
    """Jaccard overlap of two id arrays; 1 if both are empty."""
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for two result lists (id, rank): shared ids in left order, overlap."""
    ids = lambda df: F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"])
    both = left.agg(ids(left).alias("a")).crossJoin(right.agg(ids(right).alias("b")))
    return both.select(F.array_intersect("a", "b").alias("shared"), overlap("a", "b").alias("overlap"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd to usage rows (model and token counts).

    A price holds for its model and for those whose name goes on after a dash;
    the longest such name counts, an unknown model has a null cost.  The price
    table is a dimension of few rows.
    """
    known = prices.select(F.col("model").alias("priced"), "input", "output", "cache_read")
    # Prices are matched with the distinct models, by the part of the name before each dash.
    models = usage.select("model").distinct()
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split("model", "-"))), lambda i: F.array_join(F.slice(F.split("model", "-"), 1, i), "-"))
    best = models.select("model", F.explode(parts).alias("priced")).join(known, "priced").groupBy("model").agg(F.max_by(F.struct("input", "output", "cache_read"), F.length("priced")).alias("p"))
    rows = usage.join(best, "model", "left").select(*usage.columns, "p")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = (n("input_tokens") * F.col("p.input") + n("output_tokens") * F.col("p.output") + n("cache_created") * F.col("p.input") * CACHE_WRITE_FACTOR + n("cache_read_tokens") * F.col("p.cache_read")) / 1e6
    return rows.withColumn("cost_usd", cost).drop("p")


def last_turns(turns: DataFrame, most: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_back", back).where(F.col("_back") <= most).drop("_back")


def merged_segments(spans: DataFrame, key: str = "source") -> DataFrame:
    """Overlapping spans (key, start, end, rank) as segments: key, start, end, ranks."""
    by = W.partitionBy(key).orderBy("start", "end", "rank")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("begins", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("begins").over(by.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(key, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list("rank")).alias("ranks"))
    return out.drop("segment")


USAGE = "model string, input_tokens long, output_tokens long, cache_created long, cache_read_tokens long"


@dataclass(frozen=True)
class Usage:
    """What a model call used; counters that a model does not report are 0."""

    model: str
    input_tokens: int = 0
    output_tokens: int = 0
    cache_created: int | None = 0
    cache_read_tokens: int | None = 0

    def row(self) -> tuple:
        return (self.model, self.input_tokens or 0, self.output_tokens or 0, self.cache_created or 0, self.cache_read_tokens or 0)


@dataclass(frozen=True)
class Generated:
    """What a generator returns: the text, and the usage of the call, if there was one."""

    text: str
    usage: Usage | None = None


@dataclass(frozen=True)
class Answer:
    question: str
    text: str
    passages: DataFrame
    usage: Usage | None = None
    cost_usd: float | None = None

    def documents(self) -> DataFrame:
        """The passages' documents, newest first."""
        return cited_documents(self.passages)


@dataclass(frozen=True)
class Variant:
    label: str
    answer: Answer


@dataclass(frozen=True)
class Comparison:
    question: str
    left: Variant
    right: Variant
    shared: list[str]
    overlap: float


def extractive(question: str, passages: list[str], on_text: Callable[[str], None] | None = None) -> str:
    """The offline generator: the first sentence of each passage with its number, piece by piece."""
    pieces = []
    for i, passage in enumerate(passages, 1):
        pieces.append(f"{' ' if pieces else ''}{passage.split('. ')[0].strip().rstrip('.')}. [{i}]")
        if on_text:
            on_text(pieces[-1])
    return "".join(pieces)


def generated(question: str, results: DataFrame, generate: Callable = extractive, on_text: Callable[[str], None] | None = None, history: list[dict[str, str]] | None = None) -> Generated:
    """What a generator makes of the top passages; without any, a fixed sentence and no call.

    A generator that takes ``on_text`` gives its text piece by piece; of another
    one the whole text is passed on at once.  One that takes ``history`` gets
    the conversation's earlier turns.
    """
    passages = [row["text"] for row in results.orderBy("rank").select("text").collect()]  # the top k only
    if not passages:
        made, told = Generated(NOTHING_FOUND), False
    else:
        takes = inspect.signature(generate).parameters
        told = on_text is not None and "on_text" in takes
        more = ({"on_text": on_text} if told else {}) | ({"history": history} if history and "history" in takes else {})
        made = generate(question, passages, **more)
        made = made if isinstance(made, Generated) else Generated(made)
    if on_text and not told:
        on_text(made.text)
    return made


def answer(question: str, results: DataFrame, generate: Callable = extractive, on_text: Callable[[str], None] | None = None) -> str:
    return generated(question, results, generate, on_text).text


CITED = r"\[(\d+)\](?!\()"


def citations(text: str | Column, sources: Column) -> Column:
    """``array<int>``: the numbers cited in a text that name one of so many sources, in text order, each once."""
    text = F.col(text) if isinstance(text, str) else text
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CITED), 1), lambda n: F.when(F.char_length(n) <= 9, n.cast("int")))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= sources)))


def linked(text: str | Column, sources: Column, link: Callable[[Column], Column]) -> Column:
    """The text with every valid citation turned into ``link(number)``; other brackets stay."""
    text = F.col(text) if isinstance(text, str) else text
    gaps, numbers = F.split(text, CITED), F.regexp_extract_all(text, F.lit(CITED), 1)

    def shown(number: Column) -> Column:
        n = F.when(F.char_length(number) <= 9, number.cast("int"))
        return F.when((n >= 1) & (n <= sources), link(n)).otherwise(F.concat(F.lit("["), number, F.lit("]")))

    marks = F.concat(F.transform(numbers, shown), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")


class Chat:
    """Turns of one conversation; only the last ``most`` are sent along."""

    def __init__(self, search: Callable[[str], DataFrame], generate: Callable = extractive, most: int = 10):
        self.search, self.generate, self.most = search, generate, most
        self.turns: list[tuple[str, str]] = []
        self.usage: Usage | None = None

    def history(self) -> list[dict[str, str]]:
        return [m for q, a in self.turns[-self.most :] for m in ({"role": "user", "content": f"Question: {q}"}, {"role": "assistant", "content": a})]

    def ask(self, question: str, on_text: Callable[[str], None] | None = None) -> str:
        """The answer; a turn without passages is no part of the conversation. ``usage`` is that of the last call."""
        made = generated(question, self.search(question), self.generate, on_text, self.history())
        self.usage = made.usage
        if made.text != NOTHING_FOUND:
            self.turns.append((question, made.text))
        return made.text

    def reset(self) -> None:
        self.turns.clear()
