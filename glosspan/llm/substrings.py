"""Repeated-passage removal: prefix doubling over sampled suffix positions.

A byte goes if it is covered by a string of ``length`` bytes (100) that also
starts earlier: in a document with a smaller doc_id, or earlier in the same
one.  Prefix doubling ranks positions by their first h bytes at growing h and
drops a position as soon as its rank is unique, or h passes the threshold.  To
rank *every* position would shuffle 16 bytes for each byte of text and round;
here the positions are thinned first, without losing a match:

1. *Positions*: in every string of ``length`` bytes, the leftmost 36-byte
   substring of least hash is its anchor.  Equal strings have equal anchors at
   equal offsets, so ranking anchors (one position in about 33) suffices.
2. *Rank at 36 bytes*: (hash, text, position) rows are sorted by hash, within
   each task, then over all; an anchor whose prefix occurs once drops out.
3. *Rank at the threshold*: within a task, the strings of the anchors left are
   ranked by all their bytes; what occurred before marks its bytes there and
   then.  The others ship their bytes, sorted by (hash, doc_id, position); within
   an equal prefix, strings are re-ranked, and all but the first occurrence mark
   their bytes.  The sorted rows are streamed; what is kept is one hash for each
   distinct string of the current anchor.  Strings of an anchor that occurs more
   than HOT times are sorted by their own hash instead, so no task keeps more
   than those of HOT anchors (more only beyond 2**20 hot anchors).
4. *Removal*: marked ranges are merged per document and cut out.

Whole-text copies are settled before: only the first of equal texts takes part,
and a copy of ``length`` bytes or more goes entirely.

Ranks are 64-bit hashes: two different strings count as equal with probability
about N^2 / 2^65 among N that share a rank.

Defined results: a null text is empty; rows that repeat a doc_id with one text
are one document; a null doc_id comes after all others; documents shorter than
``length`` lose nothing; an empty table gives an empty result; columns other
than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.arrow import slices, utf8
from glosspan.llm.common import parts, staged, table, text_or_empty
from glosspan.llm.exact_dedup import attach
from glosspan.llm.jaccard import BYTES, PIECE, U, mix, powers
from glosspan.llm.recurring import recurring
from glosspan.llm.scan import kept_by_map

LENGTH, ANCHOR = 100, 36
#: Bytes of text within which strings are compared before they are sent on.
COMPARED = 1 << 19
#: Strings of an anchor that occurs more often are dealt out one by one.
HOT = 1 << 14
#: Bits of a position within a piece of text; the other bits of the key order by hash.
PLACE = 31
NEVER = 2**63 - 1


def rolling(body: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position, of their content only."""
    n = len(body)
    if n < width:
        return np.empty(0, U)
    up, down = powers(1 << max(18, (n - 1).bit_length()))
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTES[body] * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def anchors(body: np.ndarray, ends: np.ndarray, length: int = LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of consecutive texts: hash, place, text number, first and last start of the strings anchored."""
    none = np.empty(0, np.int64)
    hashes = rolling(body, width)
    span = length - width + 1
    if len(hashes) < span:
        return hashes[:0], none, none, none, none
    mask = U((1 << PLACE) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=U)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    place = (least & mask).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(place)), "right") - 1
    start = np.flatnonzero(np.arange(len(place)) + length <= ends[text + 1])
    place, text = place[start], text[start]
    if not len(start):
        return hashes[:0], none, none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return hashes[place[first]], place[first], text[first], start[first], start[last]


def _pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        for i, j in slices(ends, size):
            yield batch.slice(i, j - i), body[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def positions(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(rank, node, at) of every anchor; rows have node (hash of the text) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, ends in _pieces(batches):
            rank, place, text, _, _ = anchors(body, ends, length, width)
            node = batch.column("node").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(node), pa.array((place - ends[text]).astype(np.int32))], ["rank", "node", "at"])

    return rows.mapInArrow(run, "rank long, node long, at int")


def hot_ranks(found: DataFrame) -> np.ndarray:
    """The ranks with more than HOT anchors, sorted; with more anchors the bound rises, so that there are 2**20 at most."""
    total = found.count()
    counts = found.groupBy("rank").count().where(F.col("count") > max(HOT, total >> 20))
    return np.sort(np.array([row["rank"] for row in counts.select("rank").toLocalIterator()], np.int64))


def surroundings(rows: DataFrame, hot: np.ndarray, length: int, width: int) -> DataFrame:
    """What must be compared, and what needs no comparison, of the anchors listed in ``at`` of each row.

    (rank, node, place, start, stop, body): where ``body`` is not null, the
    strings that an anchor stands for and that this task has not met before, the
    first of which begins at ``start``; else a span whose strings have occurred
    before in this task's texts.  ``place`` orders documents.  A string of a hot
    anchor goes alone, and its own hash takes the place of the rank.
    """
    held = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, ends in _pieces(batches, COMPARED):
            node, doc = batch.column("node").to_numpy(), batch.column("place").to_numpy()
            order = np.lexsort((node, doc))
            again = np.zeros(len(order), bool)  # rows that repeat a document
            again[order[1:]] = (node[order[1:]] == node[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
            turn = np.empty(len(order), np.int64)
            turn[order] = np.arange(len(order))
            rank, place, text, first, last = anchors(body, ends, length, width)
            listed = batch.column("at")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            keep = np.isin(place, listed.flatten().to_numpy().astype(np.int64) + ends[owner]) & ~again[text]
            rank, text, first, last = rank[keep].view(np.int64), text[keep], first[keep], last[keep]
            by_turn = np.argsort(turn[text], kind="stable")
            rank, text, first, last = rank[by_turn], text[by_turn], first[by_turn], last[by_turn]
            count = last - first + 1
            row = np.repeat(np.arange(len(first)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - first, count)
            strings = rolling(body, length)[at] if len(at) else np.empty(0, U)
            _, new = np.unique(strings, return_index=True)
            known = np.ones(len(strings), bool)
            known[new] = False
            single = np.zeros(len(strings), bool) if not len(held.value) else np.isin(rank, held.value)[row]
            # Runs of strings of one anchor that are alike: known, or not; those of hot anchors are runs of one.
            edge = np.ones(len(strings) + 1, bool)
            edge[1:-1] = (row[1:] != row[:-1]) | (known[1:] != known[:-1]) | (single[1:] & ~known[1:])
            begin = np.flatnonzero(edge)
            begin, stop = begin[:-1], begin[1:] - 1
            own = text[row[begin]]
            whole = body.tobytes()
            cut = [None if k else whole[a : b + length] for k, a, b in zip(known[begin].tolist(), at[begin].tolist(), at[stop].tolist(), strict=True)]
            spread = mix(node[own].view(U) + at[begin].astype(U)).view(np.int64)  # a span needs no other one
            key = np.where(known[begin], spread, np.where(single[begin], strings[begin].view(np.int64), rank[row[begin]]))
            columns = [pa.array(key), pa.array(node[own]), pa.array(doc[own]), pa.array((at[begin] - ends[own]).astype(np.int32)), pa.array((at[stop] + length - ends[own]).astype(np.int32)), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rank", "node", "place", "start", "stop", "body"])

    return rows.mapInArrow(run, "rank long, node long, place long, start int, stop int, body binary")


def repeats(around: DataFrame, length: int) -> DataFrame:
    """(node, place, begin, end): bytes of strings that occurred before."""
    dealt = around.repartition(parts(around.sparkSession), "rank").sortWithinPartitions("rank", "place", "node", "start")
    names = ["node", "place", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, current, before = np.empty(0, U), None, None
        for batch in batches:
            spans = batch.filter(pc.is_null(batch.column("body")))
            if spans.num_rows:
                yield pa.RecordBatch.from_arrays([spans.column(c) for c in ("node", "place", "start", "stop")], names)
            batch = batch.filter(pc.is_valid(batch.column("body")))
            # Rows that repeat a document list its strings again, as neighbours.
            keys = np.stack([batch.column(c).to_numpy() for c in ("rank", "place", "node", "start")], axis=1)
            again = np.concatenate([[before is not None and (keys[:1] == before).all()], (keys[1:] == keys[:-1]).all(axis=1)])[: len(keys)]
            before = keys[-1:] if len(keys) else before
            batch = batch.filter(pa.array(~again.astype(bool))) if again.any() else batch
            body, ends = utf8(batch.column("body"))
            rank = batch.column("rank").to_numpy()
            for i, j in slices(ends, PIECE):
                at = ends[i : j + 1] - ends[i]
                hashes = rolling(body[ends[i] : ends[j]], length)
                count = np.diff(at) - length + 1
                row = np.repeat(np.arange(j - i), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                strings = hashes[at[row] + step]
                _, first = np.unique(strings, return_index=True)
                known = np.ones(len(strings), bool)
                known[first] = False
                if current is not None and rank[i] == current:
                    ahead = row < np.searchsorted(rank[i:j] != current, True)  # the rows that go on with it
                    known[ahead] |= np.isin(strings[ahead], seen)
                else:
                    seen = np.empty(0, U)
                tail = rank[i:j][row] == rank[j - 1]
                if rank[j - 1] != current:
                    seen = np.empty(0, U)
                seen, current = np.union1d(seen, strings[tail]), rank[j - 1]
                begins = np.flatnonzero(known & ~(np.concatenate([[False], known[:-1]]) & (step > 0)))
                stops = np.flatnonzero(known & ~(np.concatenate([known[1:], [False]]) & (np.concatenate([step[1:], [0]]) > 0)))
                own = row[begins]
                start = batch.column("start").to_numpy()[i:j][own]
                columns = [pa.array(batch.column(c).to_numpy()[i:j][own]) for c in ("node", "place")]
                columns += [pa.array((start + step[begins]).astype(np.int32)), pa.array((start + step[stops] + length).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return dealt.mapInArrow(run, "node long, place long, begin int, end int")


def cut_out(rows: DataFrame) -> DataFrame:
    """(node, place, n_removed, n_spans, kept) for rows with text and lists ``begins``, ``ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                body, runs = text.as_py().encode(), []
                for a, b in sorted((s["begin"], s["end"]) for s in spans):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(body[at:a])
                    at = b
                made.append((sum(b - a for a, b in runs), len(runs), b"".join([*kept, body[at:]])))
            columns = [batch.column("node"), batch.column("place"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "place", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "node long, place long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``changed`` of :func:`changes` holds the bytes that stay.
    """
    rows, changed = changes(docs, length, width)
    few = staged(changed.select(F.col("node").alias("_node"), F.col("place").alias("_place"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), "changed")
    out = rows.join(few, (F.col("node") == F.col("_node")) & (F.col("place") == F.col("_place")), "left")
    copy = ~F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def changes(docs: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """All rows with their representative among equal texts; and the kept bytes of texts that lose some."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("place")
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    texts = docs.select(place, text_or_empty().alias("text"), F.xxhash64(digest).alias("node"))
    marks = staged(docs.select("doc_id", place, digest.alias("digest"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes")), "marks")
    groups = marks.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = staged(groups.withColumn("alone", F.col("group_size") == 1), "groups")
    rows = attach(marks, groups).withColumn("node", F.xxhash64("digest"))
    found = recurring(positions(texts.select("node", "text"), length, width), "rank", ["node", "at"])
    holders = groups.select(F.xxhash64("digest").alias("node"), F.coalesce("keep_id", F.lit(NEVER)).alias("place"))
    listed = found.groupBy("node").agg(F.collect_list("at").alias("at")).join(holders, "node")
    listed = staged(listed, "alive")
    asked = kept_by_map(texts, listed.select("place"), "place").alias("t").join(listed.alias("l"), F.expr("t.node = l.node AND t.place = l.place")).select("t.node", "t.place", "t.text", "l.at")
    spans = repeats(surroundings(asked, hot_ranks(found), length, width), length)
    spans = spans.groupBy("node", "place").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = staged(spans, "spans")
    cut = kept_by_map(texts, spans.select("place"), "place").alias("t").join(spans.alias("s"), F.expr("t.node = s.node AND t.place = s.place")).select("t.node", "t.place", "t.text", "s.spans")
    return rows, cut_out(cut).dropDuplicates(["node", "place"])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`remove_repeats` over all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_repeats": op10_repeats}
ORACLES: dict[str, str] = {}
