"""Importance resampling towards a target distribution, over hashed n-gram features.

Features are runs of one to three words; each falls into one of BUCKETS by the
CRC-32 of its bytes.  The document-by-bucket count matrix is sparse and is
written once, as blocks of rows in compressed form (CSR): for a block of
documents the row starts, the bucket of every non-zero and its count.  All that
follows reads the blocks: column sums give the raw and the target distribution,
these give each bucket's gain, and the product of the matrix with the gains is
each document's weight.  What reaches the driver is one number a bucket.

The CRC of a run follows from those of its words (a CRC is linear: appending n
bytes is a fixed map for each n), so a word is hashed once however many runs it
is in.  A text longer than SLICE is counted in pieces that end between words,
each beginning with the last two words of the one before.

Weights get a Gumbel key from a seeded hash of doc_id, so taking the highest is
drawing without replacement in proportion to importance.  Documents are ranked
by a range partitioning and counts per partition; no task sees all of them.

Defined results: a null or empty text has no feature and weight 0; repeated rows
are scored and drawn one by one; ties go to the smaller doc_id, null ids last
(a null id is hashed as no characters); an empty target is a distribution
without counts; an empty table gives an empty result; columns other than doc_id
and text, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.arrow import slices, utf8
from glosspan.llm.common import staged, table
from glosspan.llm.mixing import ordered_rank

BUCKETS = 10_000
MOST_WORDS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text that are counted at a time.
SLICE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK = "doc_id array<long>, n_words array<long>, start array<long>, bucket binary, n binary"


def _byte_table() -> np.ndarray:
    """CRC-32 of single bytes, by its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


BYTE = _byte_table()


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by four tables of 256 (along the last two axes)."""
    return tables[..., 0, crc & 255] ^ tables[..., 1, (crc >> 8) & 255] ^ tables[..., 2, (crc >> 16) & 255] ^ tables[..., 3, crc >> 24]


def _tables(images: np.ndarray) -> np.ndarray:
    """The four tables of the map that takes bit i to images[i]."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ images[8 * byte + bit]
    return out


@functools.lru_cache(64)
def _doubled(power: int) -> np.ndarray:
    """Appending 2**power bytes of zero."""
    if power == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _tables(BYTE[bits & 255] ^ (bits >> np.uint32(8)))
    half = _doubled(power - 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return _tables(_mapped(half, _mapped(half, bits)))


@functools.lru_cache(4096)
def appended(n: int) -> np.ndarray:
    """What n more bytes do to the CRC of those before: the four tables of that map."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(n.bit_length()):
        if n >> power & 1:
            images = _mapped(_doubled(power), images)
    return _tables(images)


def _spaced(crc: np.ndarray) -> np.ndarray:
    """The CRC after one more space."""
    state = ~crc
    return ~(BYTE[(state ^ 32) & 255] ^ (state >> np.uint32(8)))


def buckets(found: list[bytes], row: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of consecutive words that end at or after word ``known``."""
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    one = np.fromiter((zlib.crc32(w) for w in number), np.uint32, len(number))[at]
    sizes, which = np.unique(np.fromiter(map(len, number), np.int64, len(number)), return_inverse=True)
    tables = np.stack([appended(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    size = which[at]

    def after(left: np.ndarray, k: int) -> np.ndarray:
        """The CRC of each run before, a space, and the word k places on."""
        crc, way = _spaced(left), size[k:]
        moved = tables[way, 0, crc & 255] ^ tables[way, 1, (crc >> 8) & 255] ^ tables[way, 2, (crc >> 16) & 255] ^ tables[way, 3, crc >> 24]
        return moved ^ one[k:]

    rows, out, runs = [], [], one
    for k in range(MOST_WORDS):
        if k:
            runs = after(runs[:-1], k) if len(runs) > 1 else runs[:0]
        ends = np.arange(k, k + len(runs))
        fits = (row[ends] == row[ends - k]) & (ends >= known)
        rows.append(row[ends][fits])
        out.append((runs[fits] % BUCKETS).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def pieces(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that do not cut a word."""
    begin = 0
    while begin < len(data):
        cut = NO_WORD.search(data, begin + size)
        end = cut.start() if cut else len(data)
        yield data[begin:end]
        begin = end


def counted(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, row starts, buckets, counts): some texts as sparse rows."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        dense, words, tail = np.zeros(BUCKETS, np.int64), 0, []
        for piece in pieces(texts[0]):
            found = WORD.findall(piece)
            words += len(found)
            _, of = buckets(tail + found, np.zeros(len(tail) + len(found), np.int64), len(tail))
            dense += np.bincount(of, minlength=BUCKETS)
            tail = (tail + found)[1 - MOST_WORDS :]
        at = np.flatnonzero(dense)
        return [words], np.array([0, len(at)]), at, dense[at]
    found = [WORD.findall(t) for t in texts]
    sizes = [len(f) for f in found]
    rows, of = buckets([w for f in found for w in f], np.repeat(np.arange(len(texts)), sizes))
    keys, counts = np.unique(rows * BUCKETS + of, return_counts=True)
    return sizes, np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS), keys % BUCKETS, counts


def packed(starts: np.ndarray, of: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Buckets as steps from the one before in their row, and counts in as few bytes each as the largest needs."""
    steps = np.diff(of, prepend=0)
    first = starts[:-1][np.diff(starts) > 0]
    steps[first] = of[first]
    return steps.astype("<u2").tobytes(), counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpacked(starts: np.ndarray, bucket: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(bucket, "<u2").astype(np.int64)
    ahead = np.concatenate([[0], np.cumsum(steps)])
    of = ahead[1:] - np.repeat(ahead[starts[:-1]], np.diff(starts))
    return of, np.frombuffer(n, f"u{len(n) // max(len(of), 1) or 1}").astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["doc_id", "n_words", "start", "bucket", "n"], [*[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
    for batch in batches:
        body, offsets = utf8(batch.column(1))
        for i, j in slices(offsets, SLICE):
            sizes, starts, of, counts = counted([body[offsets[r] : offsets[r + 1]].tobytes().lower() for r in range(i, j)])
            columns = [batch.column(0).slice(i, j - i).to_pylist(), sizes, starts, *packed(starts, of, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names)


def matrix(docs: DataFrame, label: str = "counts") -> DataFrame:
    """The document-by-bucket counts as persisted CSR blocks."""
    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, BLOCK), label)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, words, row starts, buckets, counts) of each block."""
    for i in range(batch.num_rows):
        ids, words, starts, bucket, n = (batch.column(k)[i] for k in range(5))
        starts = starts.values.to_numpy()
        yield ids.values.to_pylist(), words.values.to_numpy(), starts, *unpacked(starts, bucket.as_py(), n.as_py())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for *_, of, n in _rows(batch):
            # Sums of doubles stay exact far beyond what one block can hold.
            total += np.bincount(of, n, BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])


def column_sums(blocks: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the whole matrix."""
    partial = blocks.mapInArrow(_sums, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target to raw share, for each bucket."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    ratio = ((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """The matrix times the gains: doc_id, n_words, n_features, weight, score for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, starts, of, n in _rows(batch):
                ahead = np.concatenate([[0], np.cumsum(gain[of] * n)])
                weight = ahead[starts[1:]] - ahead[starts[:-1]]
                features = sum(np.maximum(words - k, 0) for k in range(MOST_WORDS))
                score = weight + np.fromiter((gumbel(i, seed) for i in ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words), pa.array(features), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if not drawn).

    ``target`` has texts in a column ``text``; of the N documents with at least
    ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    blocks = matrix(docs)
    goal = matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-counts")
    rows = staged(weights(blocks, gains(column_sums(blocks), column_sums(goal)), seed), "weights")
    long_enough = F.col("n_words") >= least_words
    drawn = percent * rows.where(long_enough).count() // 100
    place = ordered_rank(rows.where(long_enough), [F.desc("score"), F.asc_nulls_last("doc_id")])
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return place.select(*columns, rank.alias("rank")).unionByName(rows.where(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 byte by byte from the hexadecimal digits of each distinct feature's UTF-8 bytes.
ORACLE = r"""
WITH poly AS (
  SELECT list(x ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
    FROM (SELECT unnest(range(256)) AS b))),
w AS (
  SELECT row_number() OVER () AS rn, doc_id, 0 AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT -row_number() OVER () AS rn, NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (
  SELECT rn, target, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) || list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w),
g AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS k
  FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM f), poly),
n AS (SELECT rn, target, k, count(*) AS n FROM f JOIN g USING (g) GROUP BY ALL),
c AS (
  SELECT k, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM n GROUP BY k),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
gain AS (
  SELECT k, floor(1000 * ln(((c.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE) / ((c.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS gain FROM c, a),
v AS (SELECT rn, sum(n * gain)::BIGINT AS weight FROM n JOIN gain USING (k) WHERE target = 0 GROUP BY rn),
d AS (
  SELECT w.rn, doc_id, len(ws) AS n_words, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN v USING (rn) WHERE target = 0),
r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM d WHERE n_words >= 20),
z AS (SELECT 5 * count(*) // 100 AS most FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN r.rank <= z.most THEN r.rank END AS rank FROM z, d LEFT JOIN r USING (rn)
"""

QUERIES = {"op12_importance": op12_importance}
ORACLES = {"op12_importance": ORACLE}
