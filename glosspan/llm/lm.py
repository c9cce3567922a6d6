"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is coded as its lower-cased words, each followed by a blank, then one end
sign.  Every byte of that is a path of binary decisions in a Huffman tree over
bytes, one tree for each byte before.  For each decision, predictors look up
log-odds in a slot hashed from their context and the tree node: the last one,
two and four bytes, which run over word borders, the word so far, and the word so
far with the whole word before it.
Their log-odds are mixed by weights; which weights apply is gated by how many of
the three longest contexts are known and by the place in the word.  A last stage
refines the mixed probability by what followed such probabilities at that node.

*Online.* While a document is coded, its own offsets to the weights and its own
corrections of the last stage are moved by gradient steps after each of its
segments (64 bytes, 64, 128, 256 ... up to 8,192 at a time), so a document is
coded by what the corpus taught and what its own earlier text taught.

*Whole words.* The product of a word's decisions is mixed with the word's share
of all training tokens, ``P = g c/N + (1 - g) P_bits``.  Both parts sum to one,
so ``P`` does; g moves with each segment of a document to the part that has
explained its words so far (rarer words than the TOP count for neither part).
The counts c are exact and grow with the corpus: those of the TOP most frequent
words are broadcast, all others joined.

Training, on documents whose crc32 leaves a remainder:

1. words and bytes are counted over all training texts;
2. each task codes its texts with what it has learned from those before, moves
   the weights, then counts; the tasks' slot counts are summed in blocks, their
   weights averaged by decisions.

The predictors' tables have half as many slots as there are distinct training
words, to the next power of two, between 2**MIN_BITS and 2**MAX_BITS: what is
broadcast is one byte a slot, 17 MB at most.  Contexts may share slots; counts
are 64-bit sums.  ``bits_per_byte`` is the code length over the coded bytes.

The base score is an add-0.1 unigram over the same counts (words are keyed by
64-bit hashes).

Defined results: a null text is empty and has one token, the end; a null doc_id
trains; repeated rows score alike; without training text every word is unknown
and every decision is even; an empty table gives an empty result; other columns
of the documents, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.arrow import slices, utf8
from glosspan.llm.common import crc_mod, staged, table, text_or_empty
from glosspan.llm.jaccard import BASE, U, mix, powers

PIECE = 1 << 20
#: Symbols that are mixed at a time: their arrays fit a processor's cache.
CHUNK = 1 << 13
#: The signs after a word and after a text; neither occurs in a word.
GAP, END = 32, 10
SYMBOLS, NODES = 256, 255
#: Bytes of context; the last two predictors' contexts are the word so far, without and with the word before.
ORDERS = (1, 2, 4)
PREDICTORS = len(ORDERS) + 2
MIN_BITS, MAX_BITS = 14, 22
#: Learners apart from each other, at least; more where each has as many bytes as its tables take.
LEAST_TASKS = 16
BLOCK = 1 << 16
TOP = 1 << 18
#: Gates: known long contexts (0 to 3) by place in the word (0, 1, further).
GATES, LEVELS = 12, 24
#: Log-odds are kept in eighths.
UNIT = 8
#: Sizes of gradient steps: in training, for a document's offsets, and the decisions that a step goes against.
RATE, OWN_RATE, INERTIA = 0.5, 1.0, 256
#: First and longest segment of a document.
SEGMENT, LONGEST = 64, 8192
#: The part that a word's share of the training tokens has in its probability at a text's start, and the tokens that this counts for.
WHOLE, BELIEF = 0.3, 16
#: The hash under which the end token is counted.
END_HASH = np.int64(-1)
SPREAD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Stream:
    """Consecutive texts as they are coded.

    ``symbols``, and ``start``, each text's first symbol; by token: ``begin``
    (its first symbol), ``text``, ``hash``.
    """

    def __init__(self, body: np.ndarray, ends: np.ndarray):
        n, self.texts = len(body), len(ends) - 1
        body = body + (((body - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
        blank = (body == 32) | ((body - np.uint8(9)) < 5)
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        first = np.flatnonzero(~blank & (before | edge[:-1]))
        last = np.flatnonzero(~blank & (after | edge[1:])) + 1
        words = np.searchsorted(first, ends)
        closing = words[1:] + np.arange(self.texts)  # each text's end comes after its words
        tokens = len(first) + self.texts
        word = np.ones(tokens, bool)
        word[closing] = False
        self.size, source = np.ones(tokens, np.int64), np.zeros(tokens, np.int64)
        self.size[word], source[word] = last - first + 1, first
        stop = np.cumsum(self.size)
        self.begin, total = stop - self.size, int(stop[-1]) if tokens else 0
        self.text = np.repeat(np.arange(self.texts), np.diff(words) + 1)
        at = np.repeat(source - self.begin, self.size)
        at += np.arange(total)
        self.symbols = np.take(body, at, mode="clip") if n else np.zeros(total, np.uint8)
        self.symbols[stop[word] - 1] = GAP
        self.symbols[stop[closing] - 1] = END
        self.start = self.begin[closing - np.diff(words)] if self.texts else self.begin
        up, self.down = powers(1 << max(20, total.bit_length()))
        self.sums = np.zeros(total + 1, U)
        np.cumsum((self.symbols.astype(U) + U(1)) * up[:total], out=self.sums[1:])
        self.hash = mix((self.sums[stop - 1] - self.sums[self.begin]) * self.down[self.begin] + self.size.astype(U)).view(np.int64)
        self.hash[closing] = END_HASH

    def prepare(self) -> Stream:
        """Add by symbol: ``back`` (the bytes before, in their text), ``word`` (hash of the word so far), ``words`` (and of the one before), ``inside`` (place in the word, 2 at most)."""
        total = len(self.symbols)
        wide = self.symbols.astype(U)
        self.back = np.zeros(total, U)
        for i in range(1, ORDERS[-1] + 1):
            self.back[i:] |= wide[:-i] << U(8 * (i - 1))
        for i in range(ORDERS[-1]):
            here = self.start + i
            self.back[here[here < total]] &= U((1 << 8 * i) - 1)  # further texts that are shorter are set anew
        previous = np.zeros(len(self.hash), U)
        previous[1:] = self.hash[:-1].view(U)
        previous[np.searchsorted(self.begin, self.start)] = 0
        spread = lambda values: np.repeat(values, self.size)
        self.word = (self.sums[:-1] - spread(self.sums[self.begin])) * spread(self.down[self.begin])
        self.words = self.word + spread(previous * BASE)
        for each in (self.word, self.words):
            each ^= each >> U(29)
        self.inside = np.minimum(np.arange(total) - spread(self.begin), 2)
        return self


class Code:
    """A Huffman code over bytes for each byte before: every symbol's path of inner nodes and bits, from the root."""

    def __init__(self, counts: np.ndarray):
        """``counts`` of (byte before, byte); the byte before is 0 at a text's start."""
        found = [self._paths(row) for row in counts.reshape(SYMBOLS, SYMBOLS).tolist()]
        paths = [path for one in found for path in one]
        self.depth = np.array([len(path) for path in paths])
        self.offset = np.cumsum(self.depth) - self.depth
        self.nodes = np.array([node for path in paths for node, _ in path], np.int16)
        self.bits = np.array([bit for path in paths for _, bit in path], np.int16)

    @staticmethod
    def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
        heap = [(c * SYMBOLS + 1, s) for s, c in enumerate(counts)]  # symbols that never followed share one count
        heapq.heapify(heap)
        trees = []
        for number in range(SYMBOLS, SYMBOLS + NODES):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            trees.append((a[1], b[1]))
            heapq.heappush(heap, (a[0] + b[0], number))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS + NODES)]
        for node in range(NODES - 1, -1, -1):  # parents have higher numbers
            for bit in (0, 1):
                paths[trees[node][bit]] = [*paths[SYMBOLS + node], (node, bit)]
        return paths[:SYMBOLS]


def node_marks(bits: int) -> list[np.ndarray]:
    """What a node adds to the slot of each predictor; the first predictor's slots are (byte, node), shared by none."""
    nodes = np.arange(NODES, dtype=U)
    return [nodes.astype(np.int64), *((mix(nodes, 100 + k) >> U(64 - bits)).astype(np.int64) for k in range(1, PREDICTORS))]


class Decisions:
    """The decisions at some symbols: owner (number of the symbol), node, bit, each predictor's slot and the place in the word."""

    def __init__(self, stream: Stream, at: np.ndarray, code: Code, marks: list[np.ndarray], bits: int):
        back = stream.back[at]
        pair = (back & U(255)).astype(np.int64) << 8 | stream.symbols[at]
        depth = code.depth[pair]
        self.starts = np.cumsum(depth) - depth
        path = np.repeat(code.offset[pair] - self.starts, depth)
        path += np.arange(len(path))
        self.owner = np.repeat(np.arange(len(at)), depth)
        self.node, self.bit = code.nodes.take(path).astype(np.int64), code.bits.take(path).astype(np.int64)
        contexts = [((back & U((1 << 8 * order) - 1)) * SPREAD[i] >> U(64 - bits)).astype(np.int64) for i, order in enumerate(ORDERS) if i]
        contexts += [(word[at] * SPREAD[i] >> U(64 - bits)).astype(np.int64) for i, word in ((3, stream.word), (4, stream.words))]
        contexts.insert(0, pair & ~255)
        self.slots = [c.take(self.owner) ^ m.take(self.node) for c, m in zip(contexts, marks, strict=True)]
        self.inside = stream.inside[at].take(self.owner)

    def inputs(self, odds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by predictor, and the gate."""
        x = np.empty((PREDICTORS, len(self.node)), np.float32)
        known = np.zeros(len(self.node), np.int8)
        for k, slots in enumerate(self.slots):
            found = odds[k].take(slots)
            x[k] = found
            if k >= PREDICTORS - 3:
                known += found != 0
        return x, known * 3 + self.inside


def sigmoid(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def clipped(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds, -11.99, 11.99, out=odds)


def level(odds: np.ndarray) -> np.ndarray:
    return (odds + np.float32(LEVELS / 2)).astype(np.int64)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Eighths of log-odds from counts of zeros and ones in turn."""
    n = np.log(counts.reshape(-1, 2) + np.float32(0.4), dtype=np.float32)
    return np.clip(np.rint(UNIT * (n[:, 1] - n[:, 0])), -127, 127).astype(np.int8)


def sizes(bits: int) -> list[int]:
    return [1 << 16] + [1 << bits] * (PREDICTORS - 1)


class Learner:
    """What one task learns: slot counts, weights, and counts for the last stage."""

    def __init__(self, code: Code, bits: int):
        self.code, self.bits, self.marks = code, bits, node_marks(bits)
        self.counts = [np.zeros(2 * n, np.int32) for n in sizes(bits)]
        self.odds = [np.zeros(n, np.int8) for n in sizes(bits)]
        self.weights = np.full((PREDICTORS, GATES), 0.35 / UNIT, np.float32)
        self.last = np.zeros((2, NODES, LEVELS))
        self.size, self.read, self.due = 0, 0, CHUNK

    def learn(self, stream: Stream) -> None:
        stream.prepare()
        for begin in range(0, len(stream.symbols), CHUNK):
            d = Decisions(stream, np.arange(begin, min(begin + CHUNK, len(stream.symbols))), self.code, self.marks, self.bits)
            x, gate = d.inputs(self.odds)
            odds = x[0] * self.weights[0].take(gate)
            for k in range(1, PREDICTORS):
                odds += x[k] * self.weights[k].take(gate)
            np.add.at(self.last.reshape(-1), (d.bit * NODES + d.node) * LEVELS + level(clipped(odds)), 1.0)
            error = d.bit.astype(np.float32) - sigmoid(odds)
            n = np.bincount(gate, minlength=GATES) + INERTIA
            for k in range(PREDICTORS):
                self.weights[k] += RATE / UNIT**2 * np.bincount(gate, error * x[k], minlength=GATES) / n
                np.add.at(self.counts[k], d.slots[k] << 1 | d.bit, np.int32(1))
            self.size += len(d.node)
            self.read += CHUNK
            if self.read >= self.due:  # after as much again
                self.odds = [log_odds(c) for c in self.counts]
                self.due = 2 * self.read

    def rest(self) -> np.ndarray:
        """Size, weights times size, and the last stage's counts, in one vector."""
        return np.concatenate([[self.size], self.size * self.weights.reshape(-1).astype(float), self.last.reshape(-1)])


class Model:
    """Log-odds by slot, weights and the last stage's probabilities: what is broadcast."""

    def __init__(self, code: Code, bits: int, odds: list[np.ndarray], rest: np.ndarray):
        self.code, self.bits, self.odds = code, bits, odds
        cells = PREDICTORS * GATES
        self.weights = (rest[1 : 1 + cells] / rest[0] if rest[0] else np.full(cells, 0.35 / UNIT)).reshape(PREDICTORS, GATES).astype(np.float32)
        zeros, ones = rest[1 + cells :].reshape(2, NODES, LEVELS)
        self.last = ((ones + 8 * sigmoid(np.arange(LEVELS) - LEVELS / 2 + 0.5)) / (zeros + ones + 8)).astype(np.float32).reshape(-1)
        self.marks = node_marks(bits)

    def costs(self, stream: Stream) -> np.ndarray:
        """log10 of each token's probability."""
        stream.prepare()
        out = np.zeros(len(stream.symbols))
        own = np.zeros((PREDICTORS, stream.texts), np.float32)  # each document's offsets to the weights
        wrong, met = np.zeros((stream.texts, LEVELS)), np.full((stream.texts, LEVELS), float(INERTIA))
        for texts, starts, at in segments(stream.start, len(stream.symbols), SEGMENT):
            d = Decisions(stream, at, self.code, self.marks, self.bits)
            x, gate = d.inputs(self.odds)
            first = d.starts[starts]
            n = np.diff(np.append(first, len(d.node)))
            odds = x[0] * (self.weights[0].take(gate) + np.repeat(own[0][texts], n))
            for k in range(1, PREDICTORS):
                odds += x[k] * (self.weights[k].take(gate) + np.repeat(own[k][texts], n))
            step = level(clipped(odds))
            p = sigmoid(odds)
            cell = np.repeat(np.arange(len(texts)) * LEVELS, n) + step
            shift = (wrong[texts] / met[texts]).astype(np.float32).reshape(-1)
            final = (p + self.last.take(d.node * LEVELS + step)) / 2 + shift.take(cell)
            final = np.clip(final, np.float32(2e-5), np.float32(1 - 2e-5))
            bit = d.bit.astype(np.float32)
            out[at] = np.bincount(d.owner, np.log(np.abs(final - (1 - bit))), minlength=len(at))
            error = bit - p
            for k in range(PREDICTORS):
                own[k][texts] += OWN_RATE / UNIT**2 * np.add.reduceat(error * x[k], first) / (n + INERTIA)
            wrong[texts] += np.bincount(cell, bit - final, minlength=len(texts) * LEVELS).reshape(-1, LEVELS)
            met[texts] += np.bincount(cell, minlength=len(texts) * LEVELS).reshape(-1, LEVELS)
        return np.add.reduceat(out, stream.begin) / np.log(10) if len(stream.begin) else out


def segments(start: np.ndarray, total: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (in order, each once), where their items begin, and the items: segments that are coded together.

    Text i's items are those from ``start[i]`` to the next one's.  Its segments
    come one after the other, each whole in one group.
    """
    length = np.diff(np.append(start, total))
    begin, alive = 0, np.arange(len(start))
    while len(alive):
        n = np.minimum(length[alive] - begin, size)
        upto = np.cumsum(n)
        i = 0
        while i < len(alive):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
            some, long = alive[i:j], n[i:j]
            starts = np.cumsum(long) - long
            at = np.repeat(start[some] + begin - starts, long)
            yield some, starts, at + np.arange(len(at))
            i = j
        begin += size
        size = min(begin, LONGEST)
        alive = alive[length[alive] > begin]


def parts(stream: Stream, bits: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each token's g, from log10 P_bits and c/N of the tokens before it in its text."""
    out = np.empty(len(bits))
    spelled = 10.0**bits
    gained, met = np.full(stream.texts, WHOLE * BELIEF), np.full(stream.texts, float(BELIEF))
    for texts, starts, at in segments(np.searchsorted(stream.text, np.arange(stream.texts)), len(bits), BELIEF // 2):
        n = np.diff(np.append(starts, len(at)))
        out[at] = g = np.repeat(np.clip(gained[texts] / met[texts], 0.01, 0.99), n)
        of_share = g * share[at]
        gained[texts] += np.add.reduceat(np.where(share[at] > 0, of_share / np.maximum(of_share + (1 - g) * spelled[at], 1e-300), 0.0), starts)
        met[texts] += np.add.reduceat((share[at] > 0).astype(float), starts)
    return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stream]]:
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        for i, j in slices(ends, PIECE):
            yield batch.slice(i, j - i), Stream(body[ends[i] : ends[j]], ends[i : j + 1] - ends[i])


def count_all(docs: DataFrame) -> DataFrame:
    """(sign, hash, c): of all words and ends by hash (sign false), and of all pairs of coded bytes (true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.zeros(SYMBOLS**2, np.int64)
        for _, s in _streams(batches):
            hashes, n = np.unique(s.hash, return_counts=True)
            before = np.zeros(len(s.symbols), np.int64)
            before[1:] = s.symbols[:-1]
            before[s.start] = 0
            signs += np.bincount(before << 8 | s.symbols, minlength=SYMBOLS**2)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), pa.array(hashes), pa.array(n.astype(np.int64))], ["sign", "hash", "n"])
        met = np.flatnonzero(signs)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(met), bool)), pa.array(met), pa.array(signs[met])], ["sign", "hash", "n"])

    return docs.select("text").mapInArrow(run, "sign boolean, hash long, n long").groupBy("sign", "hash").agg(F.sum("n").alias("c"))


BLOCKS = "predictor int, begin int, body binary"


def _block(predictor: int, begin: int, body: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([predictor], pa.int32()), pa.array([begin], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["predictor", "begin", "body"])


def _added(batches: Iterator[pa.RecordBatch], kind: type, finish) -> Iterator[pa.RecordBatch]:
    """64-bit sums of the blocks (of ``kind``) of each key; rows come sorted by key."""
    key, total = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            at = (batch.column("predictor")[i].as_py(), batch.column("begin")[i].as_py())
            body = np.frombuffer(batch.column("body")[i].as_buffer(), float if at[0] == PREDICTORS else kind)
            if at != key:
                if key:
                    yield _block(*key, finish(key, total))
                key, total = at, body.astype(float if at[0] == PREDICTORS else np.int64)
            else:
                total += body
    if key:
        yield _block(*key, finish(key, total))


def train(docs: DataFrame, code: Code, bits: int, n_bytes: int) -> Model:
    """The model learned online over all texts, in one pass.

    A learner reads as many bytes as its tables take, where there are enough
    learners to choose from, so summing the tables costs no more than reading.
    Each text names its learner, so more partitions make no more tables.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((code, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, learner = None, None
        for batch in batches:
            numbers = batch.column("learner").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if j > i and numbers[i] != number:
                    yield from learned(learner)
                    number, learner = numbers[i], Learner(*held.value)
                for _, stream in _streams(iter([batch.slice(i, j - i)])):
                    learner.learn(stream)
        yield from learned(learner)

    def learned(learner: Learner | None) -> Iterator[pa.RecordBatch]:
        if learner and learner.size:
            for k, counts in enumerate(learner.counts):
                for b in range(0, len(counts), 2 * BLOCK):
                    block = counts[b : b + 2 * BLOCK]
                    if block.any():
                        yield _block(k, b // 2, block)
            yield _block(PREDICTORS, 0, learner.rest())

    # How texts are dealt and in which order a learner reads them depends on the texts alone, so any cluster learns the same.
    learners = max(LEAST_TASKS, n_bytes // (4 * sum(sizes(bits))))
    keyed = docs.withColumn("key", F.xxhash64(*docs.columns)).withColumn("learner", F.pmod("key", F.lit(learners)).cast("int"))
    dealt = keyed.repartitionById(learners, "learner").sortWithinPartitions("learner", "key", "text")
    blocks = dealt.select("learner", "text").mapInArrow(run, BLOCKS)
    # First within groups of tasks, then over all: no task adds up more than a share of the blocks of a key.
    keys = ["predictor", "begin"]
    some = blocks.withColumn("group", F.spark_partition_id() % 16).repartition(*keys, "group").sortWithinPartitions(*keys, "group").select("predictor", "begin", "body")
    some = some.mapInArrow(lambda batches: _added(batches, np.int32, lambda key, total: total), BLOCKS)
    whole = some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _added(batches, np.int64, lambda key, total: total if key[0] == PREDICTORS else log_odds(total)), BLOCKS)
    odds = [np.zeros(n, np.int8) for n in sizes(bits)]
    rest = np.zeros(1 + PREDICTORS * GATES + 2 * NODES * LEVELS)
    for row in whole.toLocalIterator():  # of fixed size, however many tasks there are
        if row["predictor"] == PREDICTORS:
            rest = np.frombuffer(row["body"], float)
        else:
            body = np.frombuffer(row["body"], np.int8)
            odds[row["predictor"]][row["begin"] : row["begin"] + len(body)] = body
    held.destroy()
    return Model(code, bits, odds, rest)


def most_frequent(known: DataFrame, most: int):
    """(hash, c) by hash of the words above a count, the lowest with which there are ``most`` at most.

    A histogram over eighths of powers of two finds that count, so the driver
    gets a few hundred rows and then ``most`` rows, however many tasks there are.
    """
    step = F.floor(F.log2("c") * 8)
    found = {row["step"]: row["count"] for row in known.groupBy(step.alias("step")).count().collect()}
    total, lowest = 0, None
    for at in sorted(found, reverse=True):
        total += found[at]
        if total > most:
            break
        lowest = at
    if lowest is None:
        return known.limit(0).toPandas()
    return known.where(step >= lowest).toPandas().sort_values("hash")


class Fitted:
    """The model and the counts of all words (a staged table)."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(*[F.col("doc_id").cast("long").alias("doc_id")] * ("doc_id" in docs.columns), text_or_empty().alias("text"))
        counted = staged(count_all(docs), "counts")
        self.known = counted.where(~F.col("sign")).select("hash", "c")
        n, words = self.known.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n, self.words = n or 0, words
        signs = np.zeros(SYMBOLS**2, np.int64)
        for row in counted.where("sign").collect():
            signs[row["hash"]] = row["c"]
        bits = min(max(words.bit_length() - 1, MIN_BITS), MAX_BITS)
        self.model = train(docs, Code(signs), bits, int(signs.sum()))


class Counts:
    """Counts of the most frequent words by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bits: int = 20):
        self.hashes, self.counts, self.mask = hashes, counts, (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.at[hashes & self.mask] = np.arange(len(hashes))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The words' counts; 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = self.at[hashes & self.mask]
        other = np.flatnonzero((at >= 0) & (self.hashes[at] != hashes))  # words that share a place
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.hashes, hashes[other]), len(self.hashes) - 1)
        return np.where((at >= 0) & (self.hashes[at] == hashes), self.counts[at], 0)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """One row per row of ``docs`` (doc_id, held_out, text): counts, base score, score, bits per byte."""
    spark, known, n = docs.sparkSession, fitted.known, fitted.n
    below = n + 0.1 * (fitted.words + 1)
    top = most_frequent(known, TOP)
    held = spark.sparkContext.broadcast((fitted.model, top["hash"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))
    schema = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, score double, rare array<struct<hash:long,bits:float,part:float>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, *counts = held.value
        counts = Counts(*counts)
        for rows, s in _streams(batches):
            bits = model.costs(s)
            c = counts.of(s.hash)
            found = c > 0
            part = parts(s, bits, c / max(n, 1)) if n else np.zeros(len(bits))
            base = np.log10((c[found] + 0.1) / below)
            whole = np.log10(part[found] * c[found] / max(n, 1) + (1 - part[found]) * 10.0 ** bits[found])
            total = lambda values: np.bincount(s.text[found], values, minlength=s.texts).astype(float)  # noqa: B023, E731
            rare = pa.StructArray.from_arrays([pa.array(s.hash[~found]), *(pa.array(x[~found].astype(np.float32)) for x in (bits, part))], ["hash", "bits", "part"])
            upto = np.concatenate([[0], np.cumsum(np.bincount(s.text[~found], minlength=s.texts))]).astype(np.int32)
            columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(np.append(s.start, len(s.symbols))))]
            columns += [pa.array(np.bincount(s.text, minlength=s.texts)), pa.array(np.bincount(s.text[found], minlength=s.texts)), pa.array(total(base)), pa.array(total(whole)), pa.ListArray.from_arrays(pa.array(upto), rare)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base", "score", "rare"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", text_or_empty().alias("text")).mapInArrow(run, schema)
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(known.hint("merge"), "hash", "left")
    c, bits, part = F.coalesce("c", F.lit(0)), F.col("bits").cast("double"), F.col("part").cast("double")
    whole = F.when(F.col("c").isNull(), F.log10(1 - part) + bits).otherwise(F.log10(part * c / F.lit(max(n, 1)) + (1 - part) * F.pow(F.lit(10.0), bits)))
    rare = rare.groupBy("row").agg(F.sum(F.log10((c + 0.1) / F.lit(below))).alias("more"), F.sum(whole).alias("whole"), F.count("c").alias("met"))
    out = scored.join(rare, "row", "left").withColumn("score", F.col("score") + F.coalesce("whole", F.lit(0.0)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and bits_per_byte of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))
    return score(docs, Fitted(docs.where(~F.col("held_out"))))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict[str, str] = {}
