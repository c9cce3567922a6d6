"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash of their id into a stream of
words, and the stream, repeated, is cut into blocks of equal length.  A source's
weight in the mix is the number of blocks its target needs; the cumulative
weights cut the unit interval, in cells of one block, among the sources.  Slot i
of the mix is the i-th van der Corput point (the bits of i in reverse): the cell
it falls in names its source, and its rank among that source's slots names the
block it takes.  Points beyond the last weight are no slots.  Since 2**m points
meet each cell once, the whole schedule gives every source its blocks, and any
first part of it is within a few blocks a source of its share.  A source's last
block is cut at its target.

``taken`` is what a document's words in the scheduled blocks add up to,
``first_slot`` the first slot that takes some of them, ``n_slots`` how many do:
ordering by slot gives the mix, stopping at a slot (``upto``) gives a smaller
one with the same weights.

The rank has a closed form: a run of cells is a few dyadic runs, and the points
in one of those are evenly spaced.  So slots need no sort and no shuffle.

Nothing is collected but single rows of totals.  Running sums are taken within
bounded cells (hash cells of a source) and then shifted by the cells' offsets,
so a source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0; a document of size 0 has no slot; a
null source is a source of its own, sorted last; a null doc_id hashes as the
empty string; repeated rows are documents of their own; other columns, whatever
their names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosspan.llm.common import BLANK_CLASS, parts, staged, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
#: Words in a block.
BLOCK = 256
#: Hash digits that make a cell of a source: 4,096 cells.
CELL_DIGITS = 3
#: Parts of the unit interval by which points find their source: 2**GRID_BITS, and more than there are sources.
GRID_BITS = 10
#: Sources whose running sums are taken together.
PART = 4096
KEY = ["none", "name"]


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(BLANK_CLASS.replace("[", "[^") + "+")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key (none, name), size in words, and the shuffle's hash.

    The text stays behind: the mix only needs sizes.
    """
    return docs.select("doc_id", "source", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), size_of(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))


def ordered_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` from 0 in the order given, without one task that sorts all.

    Rows are range-partitioned; ranks within a part are shifted by the parts
    before it, of which there are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    dealt = staged(rows.repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id()), "ranked")
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("part", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(before, "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source: key, source_size, weight, target, take (whole words).

    What a target has above ``ceiling`` times its source's size is shared anew
    by weight until none is above.  In the order of ceiling by weight the
    sources above are a first part, so one pass of running sums finds where it
    ends, however many sources there are.
    """
    sources = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    sources = ordered_rank(sources, KEY)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    sources = staged(sources.withColumn("weight", weight), "sources")
    top = ceiling * F.col("source_size")
    size, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = None
    if all_weights:
        order = [top / F.col("weight"), *KEY]
        cut = ordered_rank(sources.drop("rank"), order).withColumn("part", F.floor(F.col("rank") / PART))
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        # As many rows as there are parts of PART sources.
        parts_of = cut.groupBy("part").agg(F.sum(top).alias("tops"), F.sum("weight").alias("heavy"))
        ahead = parts_of.select("part", F.coalesce(F.sum("tops").over(before), F.lit(0)).alias("tops"), F.coalesce(F.sum("heavy").over(before), F.lit(0)).alias("heavy"))
        within = W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        below = F.col("tops") + F.coalesce(F.sum(top).over(within), F.lit(0))
        above = F.lit(all_weights) - F.col("heavy") - F.coalesce(F.sum("weight").over(within), F.lit(0.0))
        found = cut.join(F.broadcast(ahead), "part").withColumn("level", (F.lit(share * (size or 0)) - below) / above)
        level = found.where(F.col("level") * F.col("weight") <= top).agg(F.min_by("level", "rank")).first()[0]
    whole = top.cast("double")
    target = F.round(whole if level is None else F.least(F.col("weight") * level, whole), 6)
    return staged(sources.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5)), "targets")


def streams(rows: DataFrame) -> DataFrame:
    """Add ``start``, the place of each document in its source's shuffled stream, and (cell, seq)."""
    rows = rows.withColumn("cell", F.conv(F.substring("h", 1, CELL_DIGITS), 16, 10).cast("int"))
    cells = rows.groupBy(*KEY, "cell").agg(F.sum("size").alias("cell_size"))
    ahead = F.sum("cell_size").over(W.partitionBy(*KEY).orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(*KEY, "cell", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = W.partitionBy(*KEY, "cell").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("seq", F.row_number().over(inside))
    return rows.join(cells, [*KEY, "cell"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("ahead", "inside")


def reversed_bits(column: str, m: int) -> Column:
    """The ``m`` low bits of a number in reverse: its van der Corput point in units of 2**-m."""
    return F.conv(F.reverse(F.lpad(F.bin(column), m, "0")), 2, 10).cast("long")


def points_below(bound: str, slot: str, m: int) -> Column:
    """How many of the slots before ``slot`` have points below ``bound`` (in units of 2**-m).

    For each bit b of the bound, the points that agree with it above b and are
    lower at b are those of the slots that leave one remainder modulo 2**(m - b).
    """
    terms = []
    for b in range(m + 1):
        shared = F.shiftright(F.col(bound), b).bitwiseXOR(F.lit(1))
        remainder = _reversed(shared, m - b)
        modulus = 1 << (m - b)
        count = F.shiftright(F.col(slot) + F.lit(modulus - 1) - remainder, m - b)
        terms.append(F.when(F.shiftright(F.col(bound), b).bitwiseAND(F.lit(1)) == 1, count).otherwise(F.lit(0)))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total.cast("long")


def _reversed(value: Column, m: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(value), m, "0")), 2, 10).cast("long") if m else F.lit(0).cast("long")


def schedule(goals: DataFrame, block: int = BLOCK, upto: int | None = None) -> DataFrame:
    """The mix's slots: key, slot (its place in the mix), k (the block it takes).

    ``goals`` has key and take.  The points find their source through a grid
    over the unit interval: an equi-join on the grid's part, then the exact
    bounds.
    """
    spark = goals.sparkSession
    need = F.ceil(F.col("take") / F.lit(block)).cast("long")
    goals = staged(ordered_rank(goals.where("take > 0").select(*KEY, need.alias("need")), KEY), "goals")
    total, sources = goals.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    m = max(1, (max(total, 1) - 1).bit_length())
    cut = goals.withColumn("part", F.floor(F.col("rank") / PART))
    ahead = cut.groupBy("part").agg(F.sum("need").alias("part_need")).withColumn("ahead", F.coalesce(F.sum("part_need").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    upper = F.col("ahead") + F.sum("need").over(W.partitionBy("part").orderBy("rank"))
    bounds = cut.join(ahead.select("part", "ahead"), "part").withColumn("upper", upper.cast("long")).withColumn("lower", F.col("upper") - F.col("need"))
    wide = max(0, m - max(GRID_BITS, sources.bit_length()))
    grid = F.explode(F.sequence(F.shiftright("lower", wide), F.shiftright(F.col("upper") - 1, wide))).alias("grid")
    bounds = bounds.select(*KEY, "lower", "upper", grid)
    points = spark.range(min(1 << m, upto if upto is not None else 1 << m) if total else 0, numPartitions=parts(spark))
    points = points.select(F.col("id").alias("slot"), reversed_bits("id", m).alias("point")).withColumn("grid", F.shiftright("point", wide))
    dealt = points.join(bounds, "grid").where("point >= lower AND point < upper")
    return dealt.select(*KEY, "slot", (points_below("upper", "slot", m) - points_below("lower", "slot", m)).alias("k"))


def mix(docs: DataFrame, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING, upto: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot, n_slots.

    With ``upto``, the mix stops before that slot.
    """
    rows = staged(sized(docs), "sized")
    goals = targets(rows, weights, share, ceiling)
    rows = streams(rows).join(goals.select(*KEY, "source_size", "target", "take"), KEY)
    slots = schedule(goals, block, upto)
    begin = F.col("lap") * F.col("source_size") + F.col("start")
    laps = rows.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(ceiling - 1)))).withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("take")))
    pieces = laps.withColumn("k", F.explode_outer(F.when(F.col("begin") < F.col("end"), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))))
    shared = F.least("end", (F.col("k") + 1) * block) - F.greatest("begin", F.col("k") * block)
    met = pieces.join(slots, [*KEY, "k"], "left")
    taken = F.sum(F.when(F.col("slot").isNotNull(), shared).otherwise(0))
    out = met.groupBy(*KEY, "cell", "seq", "doc_id", "source", "size", "source_size", "target").agg(taken.cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`mix` over all documents, and first_slot (-1 for none) and n_slots."""
    return mix(table(spark, sf_dir, "documents")).drop("source").withColumn("first_slot", F.coalesce("first_slot", F.lit(-1).cast("long")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k, 1.5 * sum(source_size) OVER () AS budget FROM s),
p AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM o),
l AS (
  SELECT arg_min((budget - below) / above, k) AS level FROM p WHERE (budget - below) / above * w <= 2 * source_size),
t AS (
  SELECT source, source_size, round(least(w * level, 2.0 * source_size)::DOUBLE, 6) AS target FROM s, l),
n AS (
  SELECT source, floor(target + 0.5)::BIGINT AS take, ceil(floor(target + 0.5) / 256)::BIGINT AS need FROM t),
u AS (
  SELECT source, coalesce(sum(need) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower, need,
         greatest(1, ceil(log2(greatest(1, sum(need) OVER ())))::BIGINT) AS m
  FROM n WHERE need > 0),
i AS (SELECT unnest(range(0, (1 << m)::BIGINT)) AS slot, m FROM (SELECT DISTINCT m FROM u)),
v AS (SELECT slot, list_sum(list_transform(range(0, m), lambda j: ((slot >> j) & 1) << (m - 1 - j))) AS point FROM i),
z AS (
  SELECT u.source, v.slot, row_number() OVER (PARTITION BY u.source ORDER BY v.slot) - 1 AS k
  FROM v JOIN u ON v.point >= u.lower AND v.point < u.lower + u.need),
c AS (
  SELECT row_number() OVER () AS rn, d.doc_id, d.source, d.size, t.source_size, t.target, n.take,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN n ON n.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT rn, source, lap * source_size + a AS b, least(lap * source_size + a + size, take) AS e FROM c, (VALUES (0), (1)) x(lap)),
r AS (SELECT rn, source, b, e, unnest(range((b // 256)::BIGINT, ((e - 1) // 256)::BIGINT + 1)) AS k FROM q WHERE b < e),
x AS (
  SELECT rn, sum(least(e, (r.k + 1) * 256) - greatest(b, r.k * 256)) AS taken, min(slot) AS first_slot, count(*) AS n_slots
  FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source AND r.k = z.k GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(x.taken, 0)::BIGINT AS taken, coalesce(x.first_slot, -1)::BIGINT AS first_slot, coalesce(x.n_slots, 0)::BIGINT AS n_slots
FROM c LEFT JOIN x USING (rn)
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": ORACLE}
