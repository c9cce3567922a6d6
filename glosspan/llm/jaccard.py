"""Exact Jaccard join of shingle sets by a pigeonhole over a partitioned universe.

A document's set holds the hashes of its distinct k-word shingles.  Two sets of
sizes a and b reach the threshold t only if their symmetric difference is at
most H = floor((a + b)(1 - t) / (1 + t)).  Hash the universe into segments: if
the segments' tolerances (0: equal; 1: at most one token more or less, found by
one-deletion neighbourhoods) plus one sum to more than H, some segment of the
two sets agrees within its tolerance.

* *Size bands* have tops a factor 1/t apart, so partners lie in the same or the
  next band; a set is indexed under the scheme of its own band and of the next.
* *Allocation by cost*: per scheme, segments are all exact or all tolerant,
  with a slack of c units, whichever costs fewer signatures counting the
  expected price of weak segments.
* *Weak segments* (at most one token, so shared by chance) are not indexed
  unless a set has more than c of them.  A pair that agrees in weak segments
  only agrees in more than c of them, so both sets do index theirs: exact.
* *Before that*, sets without a partner drop out by a prefix filter: partners
  share at least l of their n - ceil(tn) + l tokens of least hash, where l is
  that of the smaller one, so a set needs as many tokens that recur elsewhere as
  the l of its smallest possible partner (l grows with n, so that a passage
  common to many texts does not keep them in).
* *Verification* counts the common hashes of the candidate pairs.

Equal sets are one class from the start.  Within a bucket, every set is paired
with the bucket's centre first, the set that shares most signatures.  What these
links connect needs no further test.  Buckets that still hold several components
are joined into clusters, and within a cluster only sets of different components
are compared if their sizes are near, block against block, by sketches; only pairs that sizes and
sketches cannot rule out become rows and are verified.  A group of a thousand
copies thus costs about a thousand pairs a bucket, and no link between different
components is lost.

Hashes have 64 bits: two different shingles or classes count as one with
probability about N^2 / 2^65 over N of them.

Defined results: null and empty texts have empty sets, link with nothing, and
are their own component; equal rows are one class; a null doc_id is never a
representative where there is another; the empty table gives an empty result;
columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.arrow import slices, utf8
from glosspan.llm.common import discard, staged, table
from glosspan.llm.components import components
from glosspan.llm.recurring import recurring
from glosspan.llm.scan import marked_by_map

PIECE = 1 << 18
#: A set with more weak segments than its scheme's slack costs about so many signatures.
WEAK_PRICE = 1000
SALTS = 16
#: Sets in a block of a cluster.
BLOCK = 2048
#: One more prefix token for so many tokens.
PREFIX_SHARE = 20

U = np.uint64
_rng = np.random.default_rng(20240611)
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and where each text's words begin (one more than texts).

    ``ends`` are the texts' bounds in ``body``, from 0.
    """
    if not len(body):
        return np.empty(0, U), np.zeros(len(ends), np.int64)
    size = 1 << max(18, (len(body) - 1).bit_length())
    up, down = powers(size)
    body = FOLD[body]
    blank = BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[ends] = True
    before = np.empty(len(body), bool)
    before[0], before[1:] = True, blank[:-1]
    after = np.empty(len(body), bool)
    after[-1], after[:-1] = True, blank[1:]
    first = np.flatnonzero(~blank & (before | edge[:-1]))
    last = np.flatnonzero(~blank & (after | edge[1:])) + 1
    sums = np.zeros(len(body) + 1, U)
    np.cumsum(BYTES[body] * up[: len(body)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))
    return hashes, np.searchsorted(first, ends)


def shingle_sets(body: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(body, ends)
    count = max(0, len(words) - k + 1)
    rolled = np.zeros(count, U)
    for i in range(k):
        rolled = (rolled + words[i : i + count]) * BASE
    rolled = mix(rolled, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.zeros(1, U)
            for w in words[a:b]:
                short = (short + w) * BASE
            out.append(mix(short, b - a))
        else:
            out.append(np.empty(0, U))
    return out


class Scheme:
    """Segments of one size band: ``m`` of them, all exact or all tolerant of one token, with slack ``c``."""

    def __init__(self, top: int, bound: int):
        self.top = top
        best = None
        for slack in range(bound // 4 + 7):
            m = bound + 1 + slack
            mean = top * 0.9 / m
            weak = math.exp(-mean) * (1 + mean)
            price = m + WEAK_PRICE * _tail(m * weak, slack)
            best = min(best or (price, m, slack, False), (price, m, slack, False))
        m = bound // 2 + 1
        self.price, self.m, self.slack, self.tolerant = min(best, (m + top, m, 0, True))


def _tail(mean: float, most: int) -> float:
    """P(X > most) for a Poisson variable."""
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


class Plan:
    """Bands and schemes for a threshold of ``percent``."""

    def __init__(self, percent: int, k: int):
        self.percent, self.k = percent, k
        self.tops = [max(1, math.ceil((100 + percent) / (100 - percent) / 2) - 1)]
        self.schemes: dict[int, Scheme] = {}

    def bound(self, both: int) -> int:
        """Largest symmetric difference of two sets with ``both`` tokens together."""
        return both * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        low, high = 0, len(self.tops) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.tops[mid] >= n else (mid + 1, high)
        return low

    def scheme(self, band: int) -> Scheme:
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        if band not in self.schemes:
            self.schemes[band] = Scheme(self.tops[band], self.bound(2 * self.tops[band]))
        return self.schemes[band]

    def needed(self, n: int) -> int:
        """How many prefix tokens of a set of ``n`` a partner shares at least."""
        least = (n * self.percent + 99) // 100  # the smallest partner; both have as many as its prefix provides
        return min((least * self.percent + 99) // 100, 1 + least // PREFIX_SHARE)

    def provided(self, n: int) -> int:
        """How many shared tokens the prefix of a set of ``n`` makes room for."""
        return min((n * self.percent + 99) // 100, 1 + n // PREFIX_SHARE)

    def prefix(self, n: int) -> int:
        return n - (n * self.percent + 99) // 100 + self.provided(n) if n else 0

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """All signatures of a set; equal ones of two sets make a candidate pair."""
        own = self.band(len(tokens))
        out = []
        for band in (own, own + 1):
            scheme = self.scheme(band)
            if band == 0 or self.bound(2 * scheme.top) == 0:
                continue  # only equal sets reach the threshold there
            place = ((mix(tokens, 7) >> U(32)) * U(scheme.m) >> U(32)).astype(np.int64)
            value = mix(tokens, 11)
            sums = np.zeros(scheme.m, U)
            np.add.at(sums, place, value)
            counts = np.bincount(place, minlength=scheme.m).astype(U)
            tag = U(band << 32) + np.arange(scheme.m, dtype=U)
            if scheme.tolerant:
                out += [_signed(sums, counts, tag), _signed(sums[place] - value, counts[place] - U(1), tag[place])]
            else:
                weak = counts <= 1
                keep = slice(None) if np.count_nonzero(weak) > scheme.slack else ~weak
                out.append(_signed(sums, counts, tag)[keep])
        return np.unique(np.concatenate(out)) if out else np.empty(0, U)


def _signed(sums: np.ndarray, counts: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return mix(mix(sums + counts * BASE, 3) ^ mix(tag, 5), 13)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """256 parities: two sets' sketches differ in at most as many bits as the sets in tokens."""
    odd = np.bincount((mix(tokens, 17) >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        body, ends = utf8(batch.column("text"))
        for i, j in slices(ends, PIECE):
            yield batch.slice(i, j - i), shingle_sets(body[ends[i] : ends[j]], ends[i : j + 1] - ends[i], k)


def _class(tokens: np.ndarray) -> int:
    return int(mix(mix(tokens, 23).sum(dtype=U)[None] + U(len(tokens)), 29).view(np.int64)[0])


def read_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n, node (class of equal sets), the sketch, and the prefix tokens of each row."""
    schema = "doc_id long, n long, node long, s0 long, s1 long, s2 long, s3 long, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _texts(batches, plan.k):
            marks = np.array([sketch(s) for s in sets]).reshape(-1, 4)
            columns = [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64())]
            columns += [pa.array(marks[:, i].copy()) for i in range(4)] + [_longs([s[: plan.prefix(len(s))] for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "s0", "s1", "s2", "s3", "prefix"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def reread(docs: DataFrame, wanted: DataFrame, plan: Plan, what: str) -> DataFrame:
    """(doc_id, node, value) of the documents in ``wanted`` (node, doc_id): sketches or whole sets.

    A bit map of fixed size lets the scan skip documents; one that it lets
    through by chance adds rows that later joins drop.
    """
    made = {"sketches": parities, "sets": lambda tokens: tokens}[what]
    marked, kept = marked_by_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _texts(kept(batches), plan.k):
            values = [made(s) for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([_class(s) for s in sets], pa.int64()), _longs(values)], ["doc_id", "node", "value"])

    return marked.mapInArrow(run, "doc_id long, node long, value array<long>")


def shared_signatures(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(signature, node) of the documents in ``wanted``, where a signature is that of two nodes at least.

    Skipping documents, signing and sorting are one function: a task that hands
    signatures from one Python worker to the next needs three at a time.
    """
    marked, kept = marked_by_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(kept(batches), plan.k):
            values = [plan.signatures(s) for s in sets]
            nodes = np.repeat([_class(s) for s in sets], [len(v) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(nodes, pa.int64())], ["signature", "node"])

    return recurring(marked, "signature", ["node"], signed)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold."""
    a = sets.select(F.col("node").alias("u"), F.col("value").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("value").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    met = pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", common.alias("common"), (F.size("a") + F.size("b")).alias("both"))
    return met.where(F.col("common") * 100 >= percent * (F.col("both") - F.col("common"))).select("u", "v")


def may_link(a: str, b: str, percent: int):
    """Necessary for a link: the size bound and the parity-sketch bound."""
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    sizes = (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent)
    return sizes & (apart * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent))


def values_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, plan: Plan, what: str) -> DataFrame:
    """(node, value): sets or sketches of the wanted nodes, from their representatives' texts."""
    holders = staged(classes.join(wanted, "node", "left_semi").select("node", "doc_id"), "holders")
    made = reread(docs, holders, plan, what).alias("s").join(holders.alias("h"), F.expr("s.node = h.node AND s.doc_id <=> h.doc_id"), "left_semi")
    return staged(made.select("node", "value"), "values")


def parities(tokens: np.ndarray) -> np.ndarray:
    """A sketch of four bits and more a token: parities by hash, a power of two of words.

    Its halves, one over the other, are the sketch of half the length.
    """
    words = 1 << max(2, (len(tokens) // 16).bit_length())
    odd = np.bincount((mix(tokens, 19) & U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (node, label, cluster, n, value: a sketch) of one cluster and different labels that may link.

    Partners' sizes lie in one band or in two neighbouring ones, so only such
    sets of a cluster meet.  Those are dealt into blocks of about BLOCK sets, and
    each task compares two blocks by sizes and sketches, so a cluster of any
    size is spread out, sets needn't be shipped, and no pair becomes a row that
    these rule out.
    """
    step = math.log(100 / percent) * (1 + 1e-6)  # a little wide, for rounded logarithms
    band = F.floor(F.log("n") / F.lit(step))
    members = members.withColumn("band", band).withColumn("bands", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn("low", F.col("band") == F.col("bands"))
    sized = members.join(members.groupBy("cluster", "bands").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")), ["cluster", "bands"])
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = sized.select("cluster", "bands", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "low", "node", "label", "n", "value")

    def run(group: pa.Table) -> pa.Table:
        own, node, label, n, lower = (group.column(c).to_numpy() for c in ("own", "node", "label", "n", "low"))
        values = group.column("value").combine_chunks()
        flat, ends = values.values.to_numpy().view(U), values.offsets.to_numpy()
        words = np.diff(ends)
        i, j = (group.column(c)[0].as_py() for c in "ij")
        found = []
        for length in np.unique(words).tolist():
            # Sketches of this length, and of twice the length folded to it.
            some = np.flatnonzero((words == length) | (words == 2 * length))
            marks = np.stack([flat[ends[x] : ends[x] + length] ^ (flat[ends[x] + length : ends[x + 1]] if words[x] > length else U(0)) for x in some.tolist()])
            low, high = np.flatnonzero(own[some] == i), np.flatnonzero(own[some] == j)
            exact = words[some] == length
            for x in low.tolist():
                y = high if i != j else high[node[some[high]] > node[some[x]]]
                y = y[(label[some[y]] != label[some[x]]) & (exact[y] | exact[x]) & (lower[some[y]] | lower[some[x]])]
                y = y[np.minimum(n[some[y]], n[some[x]]) * 100 >= np.maximum(n[some[y]], n[some[x]]) * percent] if len(y) else y
                if len(y):
                    both = n[some[y]] + n[some[x]]
                    apart = np.bitwise_count(marks[y] ^ marks[x]).sum(axis=1, dtype=np.int64)
                    found += [(node[some[x]], node[some[z]]) for z in y[apart * (100 + percent) <= both * (100 - percent)].tolist()]
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("cluster", "bands", "i", "j").applyInArrow(run, "u long, v long")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, node."""
    plan = Plan(percent, k)
    read = staged(read_sets(docs, plan), "sets")
    rows = staged(read.select("doc_id", "n", "node", "s0", "s1", "s2", "s3"), "classes")
    met = recurring(read.where("n > 0").select(F.explode("prefix").alias("token"), "node"), "token", ["node"])
    met = staged(met.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("met")), "recurring")
    discard(read)
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")])
    classes = staged(classes, "nodes")
    least = F.expr(f"(n * {percent} + 99) div 100")  # as in Plan.needed
    needed = F.least(F.expr(f"(((n * {percent} + 99) div 100) * {percent} + 99) div 100"), 1 + F.floor(least / PREFIX_SHARE))
    alive = staged(classes.join(met, "node").where(F.col("met") >= needed).select("node", "doc_id"), "alive")
    buckets = staged(shared_signatures(docs, alive, plan).distinct(), "buckets")
    facts = classes.select("node", "n", "s0", "s1", "s2", "s3")
    # A bucket's centre is its set that shares most signatures: the text that the others vary.
    shared = buckets.join(buckets.groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "node")
    stars = shared.groupBy("signature").agg(F.max_by("node", F.struct("shared", "node")).alias("centre"))
    stars = buckets.join(stars, "signature").where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    first = stars.alias("p").join(facts.alias("a"), F.expr("p.node = a.node")).join(facts.alias("b"), F.expr("p.centre = b.node")).where(may_link("a", "b", percent))
    first = first.groupBy(F.col("p.node").alias("u")).agg(F.max_by(F.col("p.centre"), F.struct("p.times", "p.centre")).alias("v"))
    first = staged(first, "first")
    wanted = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = values_of(docs, classes, wanted, plan, "sets")
    links = staged(verified(first, sets, percent), "links")
    discard(sets)
    labels = components(links)
    marked = buckets.join(labels, "node", "left").select("signature", "node", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("v")).where("low <> high")
    mixed = staged(marked.join(mixed.select("signature", "v"), "signature").select(F.col("node").alias("u"), "v", "label").distinct(), "mixed")
    members = mixed.select(F.col("u").alias("node"), "label").distinct().join(components(mixed.select("u", "v")).withColumnRenamed("label", "cluster"), "node")
    members = staged(members, "members")
    sketches = values_of(docs, classes, members.select("node"), plan, "sketches")
    rest = staged(across(members.join(sketches, "node").join(classes.select("node", "n"), "node"), percent), "rest")
    discard(sketches)
    sets = values_of(docs, classes, rest.select(F.explode(F.array("u", "v")).alias("node")).distinct(), plan, "sets")
    more = staged(verified(rest, sets, percent), "links")
    discard(sets)
    labels = staged(components(links.unionByName(more)), "labels")
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("size"))
    found = named.select("node", "label").join(least.where("size > 1"), "label").select("node", "component_id")
    found = staged(found, "components").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(found, ["node", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked texts: the one with the least doc_id.

    Rows that repeat one doc_id stay or go together; rows with a null doc_id stay.
    """
    gone = join(docs, k, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id = g.doc_id"), "left_anti").select("d.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three words, 0.9."""
    return join(table(spark, sf_dir, "documents"), 3, 90).drop("node")


QUERIES = {"op9_jaccard": op9_jaccard}
ORACLES: dict[str, str] = {}
