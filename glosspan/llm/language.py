"""Language identification with language-bitmask n-gram filters.

Training counts byte n-grams (3, 4 and 5 bytes; A-Z lower-cased, other ASCII
signs as blanks) per language.  A language *contains* an n-gram that its texts
show at least LEAST times, at a rate of at least ``SHARE`` of the highest rate
of any language.  All languages share one bit-sliced Bloom filter: every slot is
a mask with one bit per language (as many 64-bit words as they need), an n-gram
sets its languages' bits in three slots, and the AND of the three slots returns
every language that contains it.  The filter has at least eight slots for each
n-gram; masks are put together by slot in Spark, so the driver gets slots, not
n-grams.

Prediction counts, over all n-grams of the whole text, how often each
language's bit comes back, takes off the count expected by chance from the
share of that language's bits that are set (to the power three), and decides
for the largest; the score is its share of the corrected counts.  ``known`` is
the share of the text's n-grams (but for all blanks) that some language
contains, corrected likewise: a text that mixes learned languages is known, too.

Training reads all training documents, or, where ``fit`` is given a bound, per
language as many of them with the smallest md5 of their id (fewer where the last
of them share one); ``op8_language`` is fitted with the bound ``PER_LANGUAGE``.
A task adds up the counts of its texts before they are shuffled.  Prediction
reads every text whole, in pieces of bounded size.

Defined results: a null text, a text without a letter (Unicode's letter
categories; numerals are none), or an empty training set gives ``und`` with
score 0; a text with letters but no known n-gram gets the language with most
training documents and score 0; ties go to the smaller name; rows with null
lang don't train, a null doc_id does; every other lang value is learned; rows
that repeat have one result each; an empty table gives an empty result; columns
other than those asked for, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspan.llm.arrow import slices, utf8
from glosspan.llm.common import crc_mod, small_batches, staged, table

PER_LANGUAGE = 1500
#: Bytes that the filter's tables take at most; where the sample's n-grams need more, the rarer ones are left out.
TABLE_BYTES = 256 << 20
GRAMS = (3, 4, 5)
SHARE = 0.6
LEAST = 3
#: The filter has 2**SLOT_BITS slots at least, and SPARE for each n-gram.
SLOT_BITS, SPARE = 20, 8
#: Hash digits by which the sample's cut is found, a step at a time.
DIGIT_BITS, STEPS = 12, 5
PIECE = 1 << 19
#: N-grams whose counts a task holds at most, at 16 bytes each, beside those of one batch; and those that it hands on at a time.
TOGETHER, ROWS = 1 << 21, 1 << 16
#: Steps of the share ``known`` by which a language's usual one is found.
KNOWN_STEPS = 1 << 12
#: Letters and a few numerals; :func:`has_letter` tells them apart.
WORD_SIGN = re.compile(r"[^\W\d_]")
MIX = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def grams(body: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte, as a 64-bit hash; len(body) - n + 1 of them."""
    count = len(body) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    packed = body[:count].astype(np.uint64)
    for i in range(1, n):
        packed <<= np.uint64(8)
        packed |= body[i : i + count]
    packed |= np.uint64(n << 48)
    packed *= MIX
    packed ^= packed >> np.uint64(29)
    packed *= np.uint64(0xBF58476D1CE4E5B9)
    return packed


def has_letter(text: str) -> bool:
    """Whether there is a letter."""
    return any(m[0].isalpha() for m in WORD_SIGN.finditer(text))


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three slots of each n-gram."""
    mask = np.uint64((1 << bits) - 1)
    again = hashes * MIX
    return [(x & mask).astype(np.int64) for x in (hashes >> np.uint64(64 - bits), again >> np.uint64(64 - bits), (again ^ hashes) >> np.uint64(20))]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and their counts."""
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of each ``TOGETHER`` n-grams or so are added up before they go on."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            hashes, counts = _added(held[lang])
            for i in range(0, len(hashes), ROWS):
                some = hashes[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(counts[i : i + ROWS])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        body, ends = utf8(batch.column("text"))
        for i, j in slices(ends, PIECE):
            for lang in sorted(set(langs[i:j])):
                found = [grams(FOLD[body[ends[r] : ends[r + 1]]], n) for r in range(i, j) if langs[r] == lang for n in GRAMS]
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                held.setdefault(lang, []).append((hashes, counts.astype(np.int64)))
                size += len(hashes)
        if size > TOGETHER:
            held = {lang: [_added(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > TOGETHER // 2:
                yield from rows()
                size = 0
    yield from rows()


class Filters:
    """The fitted filter: names, masks, and each language's chance rate."""

    def __init__(self, names: list[str], default: str, slot_bits: int = SLOT_BITS):
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(names) <= 8 * np.dtype(k).itemsize), np.uint64)
        self.bits, self.slot_bits = 8 * np.dtype(kind).itemsize, slot_bits
        self.names, self.default = names, default
        self.tables = np.zeros((max(1, -(-len(names) // self.bits)), 1 << slot_bits), kind)
        self.chance = np.zeros(len(names))

    def ready(self) -> Filters:
        """With the chance rates of the masks that are there."""
        kind = self.tables.dtype.type
        self.chance = np.array([np.mean((self.tables[i // self.bits] >> kind(i % self.bits)) & kind(1)) ** 3 for i in range(len(self.names))])
        return self

    def counts(self, body: np.ndarray) -> tuple[np.ndarray, int, int, int]:
        """Per language the n-grams of these bytes that it contains; how many some language does, how many there are, and how many not all blank."""
        out, known, total, blank = np.zeros(len(self.names)), 0, 0, 0
        body = FOLD[body]
        for begin in range(0, len(body), PIECE):
            empty = body[begin : begin + PIECE + GRAMS[-1] - 1] == 32
            for n in GRAMS:
                a, b, c = slots(grams(body[begin : begin + PIECE + n - 1], n), self.slot_bits)
                total += len(a)
                if len(a):
                    blank += np.count_nonzero(np.logical_and.reduce([empty[i : i + len(a)] for i in range(n)]))
                some = None
                for word, table in enumerate(self.tables):
                    both = table[a] & table[b] & table[c]
                    some = both != 0 if some is None else some | (both != 0)
                    here = range(word * self.bits, min((word + 1) * self.bits, len(self.names)))
                    if both.dtype == np.uint8:
                        by_mask = np.bincount(both, minlength=256)
                        out[here.start : here.stop] += [by_mask[(np.arange(256) >> i) & 1 == 1].sum() for i in range(len(here))]
                    else:
                        out[here.start : here.stop] += [np.count_nonzero(both & both.dtype.type(1 << i)) for i in range(len(here))]
                known += np.count_nonzero(some)
        return out, known, total, total - blank

    def predict(self, text: str | None, body: np.ndarray) -> tuple[str, float, float]:
        """lang_pred, score, known."""
        if not self.names or text is None or not has_letter(text):
            return "und", 0.0, 0.0
        counts, some, total, written = self.counts(body)
        counts = np.maximum(counts - total * self.chance, 0)
        known = max(0.0, some - total * (1 - np.prod(1 - self.chance))) / max(1, written)
        if not counts.any():
            return self.default, 0.0, known
        best = int(np.argmax(counts))
        return self.names[best], float(counts[best] / counts.sum()), float(known)


def sampled(docs: DataFrame, per_language: int) -> tuple[DataFrame, dict[str, int]]:
    """lang and text of the training rows, at most ``per_language`` ids a language; and all rows by language.

    The cut in each language's hashes is found by histograms: of the first
    digits of all hashes, then of the next digits of those in the bin where the
    sample ends.  Every step collects at most 2**DIGIT_BITS bins a language, and no
    language's ids come together anywhere.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    whole = DIGIT_BITS * STEPS
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, whole // 4), 16, 10).cast("long")
    ids = staged(rows.select("lang", key.alias("h")), "hashes")
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    cut, left, bins = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, per_language), None
    for step in range(STEPS):
        shift = whole - DIGIT_BITS * (step + 1)
        here = ids
        if bins is not None:
            if not bins:
                break
            ends = docs.sparkSession.createDataFrame(list(bins.items()), "lang string, bin long")
            here = ids.join(F.broadcast(ends), "lang").where(F.shiftright("h", shift + DIGIT_BITS) == F.col("bin"))
        counts: dict[str, list[tuple[int, int]]] = {}
        for r in here.groupBy("lang", F.shiftright("h", shift).alias("bin")).count().toLocalIterator():
            counts.setdefault(r["lang"], []).append((r["bin"], r["count"]))
        bins = {}
        for lang, found in counts.items():
            for place, n in sorted(found):
                if n > left[lang]:
                    cut[lang], bins[lang] = place << shift, place
                    break
                left[lang] -= n
            else:
                cut[lang] = max(cut[lang], (max(found)[0] + 1) << shift)
            if not left[lang]:
                bins.pop(lang, None)
    ends = docs.sparkSession.createDataFrame(list(cut.items()), "lang string, cut long")
    return rows.join(F.broadcast(ends), "lang").where(key < F.col("cut")).select("lang", "text"), sizes


def fit(docs: DataFrame, per_language: int | None = None) -> Filters:
    """Learn from all rows with text and lang, or from at most ``per_language`` ids a language."""
    if per_language is None:
        rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
        return learn(rows, {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()})
    return learn(*sampled(docs, per_language))


def usual_share(found: DataFrame) -> dict[str, float]:
    """By language the share ``known`` that all but one in twenty of its rows (lang, lang_pred, known) reach.

    Of all rows that are predicted right, by a histogram: at most KNOWN_STEPS
    rows a language come to the driver, and shares count in such steps, rounded
    down.
    """
    right = found.where(F.col("lang") == F.col("lang_pred"))
    steps: dict[str, list[tuple[int, int]]] = {}
    for r in right.groupBy("lang", F.floor(F.col("known") * KNOWN_STEPS).alias("step")).count().collect():
        steps.setdefault(r["lang"], []).append((r["step"], r["count"]))
    usual = {}
    for lang, counts in steps.items():
        below = sum(n for _, n in counts) // 20  # so many may stay below
        for step, n in sorted(counts):
            usual[lang] = step / KNOWN_STEPS
            below -= n
            if below < 0:
                break
    return usual


def least_count(by_gram: DataFrame, room: int) -> int:
    """The lowest count with which no more than ``room`` n-grams stay (those of the greatest count always do); 0 where all do."""
    found = {r["n"]: r["count"] for r in by_gram.groupBy(F.least("most", F.lit(1 << 16)).alias("n")).count().collect()}
    total = 0
    for n in sorted(found, reverse=True):
        total += found[n]
        if total > room:
            return min(n + 1, max(found))
    return 0


def learn(sample: DataFrame, sizes: dict[str, int]) -> Filters:
    names = sorted(sizes)
    if not names:
        return Filters([], "und")
    default = min(names, key=lambda x: (-sizes[x], x))
    numbered = sample.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "lang string, owner int")
    counted = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counted = staged(counted.join(F.broadcast(numbered), "lang").select("owner", "gram", "n"), "grams")
    totals = {r["owner"]: r["n"] for r in counted.groupBy("owner").agg(F.sum("n").alias("n")).collect()}
    rates = sample.sparkSession.createDataFrame([(i, float(n)) for i, n in totals.items()], "owner int, total double")
    room = TABLE_BYTES // (SPARE * 8 * -(-len(names) // 64))
    rated = counted.join(F.broadcast(rates), "owner").select("owner", "gram", "n", (F.col("n") / F.col("total")).alias("rate"))
    by_gram = rated.groupBy("gram").agg(F.max("rate").alias("highest"), F.max("n").alias("most"), F.collect_list(F.struct("owner", "rate")).alias("all"))  # one entry a language
    by_gram = by_gram.where(F.col("most") >= least_count(by_gram, room))
    holds = by_gram.select("gram", F.explode("all").alias("o"), "highest").where(F.col("o.rate") >= SHARE * F.col("highest")).select("gram", "o.owner")
    holds = staged(holds, "holds")
    n = holds.select("gram").distinct().count()
    out = Filters(names, default, max(SLOT_BITS, (SPARE * max(n, 1) - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column("owner").to_numpy().astype(np.int64)
            for place in slots(batch.column("gram").to_numpy().view(np.uint64), out_bits):
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(owner // kind), pa.array(np.left_shift(1, owner % kind))], ["slot", "word", "mask"])

    out_bits, kind = out.slot_bits, min(out.bits, 32)  # halves of 64-bit words, so that a mask's sign is plain
    masks = holds.mapInArrow(placed, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).select(F.col("slot").cast("int"), F.col("word").cast("short"), "mask")
    found = masks.toArrow()  # as many rows as slots at most, for each 32 languages
    slot, word, mask = (found.column(c).to_numpy().astype(np.int64) for c in ("slot", "word", "mask"))
    np.bitwise_or.at(out.tables, (word * kind // out.bits, slot), mask.astype(out.tables.dtype) << (word * kind % out.bits).astype(out.tables.dtype))
    return out.ready()


def identify(docs: DataFrame, filters: Filters, keep: list[str] = ()) -> DataFrame:
    """Columns ``keep`` of each row, then lang_pred, score and known.

    A kept ``text`` goes to Python once.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(filters)  # a table of slots, for each 64 languages

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(at)
            body, ends = utf8(texts)
            found = [held.value.predict(text.as_py(), body[ends[i] : ends[i + 1]]) for i, text in enumerate(texts)]
            columns = [batch.column(c) for c in range(len(keep))] + [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "known"])

    names = [f"c{i}" for i in range(len(keep))]
    at = list(keep).index("text") if "text" in keep else len(keep)
    renamed = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *[F.col("text").alias("_text")] * (at == len(keep)))
    schema = T.StructType([*renamed.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])
    return renamed.mapInArrow(batches, schema).toDF(*keep, "lang_pred", "score", "known")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    out = identify(docs.select("doc_id", held.alias("held_out"), "text"), fit(docs.where(~held), PER_LANGUAGE), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
ORACLES: dict[str, str] = {}
