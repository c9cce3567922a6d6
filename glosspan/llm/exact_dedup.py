"""Exact deduplication through a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one
row per digest (partial aggregation runs before the shuffle, so a text copied a
billion times costs one row per task), then a sort-merge anti-join against the
index finds the digests that are new, and only those are appended.  The
bucketed side of that join is read as it lies, without a shuffle.

Defined results: a null text counts as empty; texts of white space only are
equal to the empty text; rows that repeat one ``doc_id`` with one text are one
document listed several times and carry the same decision; a null ``doc_id``
loses every tie against a number.  An empty table gives an empty result; columns
other than doc_id and text, whatever their names, are only carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.common import BLANKS, crc_mod, parts, staged, table, text_or_empty

#: Copies of one digest are joined back through so many salted keys.
SALTS = 16


def normalised(column="text"):
    """The text without white space; null counts as empty."""
    return F.translate(text_or_empty(column), BLANKS, "")


def order(name: str):
    """Which of equal texts comes first: the longest, then the smallest id."""
    return F.struct((-F.col("n_points")).alias("minus"), F.col(name).isNull().alias("none"), F.col(name).alias("keep_id"))


class DigestIndex:
    """A table of known digests, bucketed and sorted by digest.

    Give it a ``name`` to keep it from run to run.  ``buckets`` is fixed when
    the table is created: choose it so that a bucket of the expected index fits
    a task (40 bytes a text).  One writer at a time; where two have entered one
    digest all the same, its longest, then earliest row counts.  ``compact``
    brings the files of many appends back to one sorted file a bucket.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or parts(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def create(self, batch: DataFrame) -> None:
        """An empty table for rows like the batch's, unless there is one; a compaction that broke off is ended first."""
        if not self.exists() and self.spark.catalog.tableExists(f"{self.name}_compacted"):
            self.spark.sql(f"ALTER TABLE {self.name}_compacted RENAME TO {self.name}")
        kind = batch.schema["keep_id"].dataType.simpleString()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {kind}, n_points INT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (one per digest) whose digest the index lacks."""
        return batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def better(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (one per digest) that come before what the index has for their digest."""
        known = self.rows().groupBy("digest").agg(F.min(order("keep_id")).alias("known"))
        met = batch.withColumn("own", order("keep_id")).join(known.hint("merge"), "digest")
        return met.where(F.col("own") < F.col("known")).select(batch.columns)

    def append(self, batch: DataFrame, name: str | None = None) -> None:
        """Add rows (digest, keep_id, n_points)."""
        (
            batch.select("digest", "keep_id", "n_points")
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(name or self.name)
        )

    def known(self) -> DataFrame:
        """digest and keep_id, one row per digest."""
        return self.rows().groupBy("digest").agg(F.min_by("keep_id", order("keep_id")).alias("known_id"))

    def compact(self) -> None:
        """Rewrite the index with one file a bucket and one row per digest.

        The new table is whole before the old one goes; if the run stops before
        it has taken the old one's name, ``create`` gives it that.
        """
        rows = self.rows().groupBy("digest").agg(F.min(order("keep_id")).alias("b"))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_compacted")
        self.append(rows.select("digest", F.col("b.keep_id").alias("keep_id"), (-F.col("b.minus")).alias("n_points")), f"{self.name}_compacted")
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.name}_compacted RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) and length in code points of each row."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"), F.char_length(text_or_empty()).alias("n_points"))


def reduced(seen: DataFrame) -> DataFrame:
    """One row per digest: digest, keep_id, n_points, group_size."""
    groups = seen.groupBy("digest").agg(F.min(order("doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return staged(groups.select("digest", F.col("best.keep_id").alias("keep_id"), (-F.col("best.minus")).alias("n_points"), "group_size"), "groups")


def register(seen: DataFrame, index: DigestIndex) -> DataFrame:
    """Enter a batch into the index; return digest, keep_id, group_size, alone.

    Of equal texts the longest stays, then the smallest doc_id; a text that the
    index knew before keeps its earlier representative.  ``group_size`` counts
    the batch; ``alone`` marks a text with one row, its own representative.
    """
    groups = reduced(seen)
    index.create(groups)
    index.append(index.unseen(groups))
    return settled(groups, index)


def settled(groups: DataFrame, index: DigestIndex) -> DataFrame:
    """digest, keep_id, group_size, alone of the groups, by what the index has."""
    joined = groups.join(index.known().hint("merge"), "digest")
    alone = (F.col("group_size") == 1) & F.col("keep_id").eqNullSafe(F.col("known_id"))
    return joined.select("digest", F.col("known_id").alias("keep_id"), "group_size", alone.alias("alone"))


def register_all(seen: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """Enter rows batch by batch (dealt by a checksum of doc_id), then settle all of them together.

    Each batch's digests meet the index by an anti-join; besides new ones, a
    batch adds rows that come before what the index has, so the representative
    is that of all rows, however they were dealt.
    """
    dealt = seen.withColumn("_batch", crc_mod("doc_id", batches))
    every = None
    for batch in range(batches):
        mine = F.col("_batch") == batch
        groups = reduced(dealt.where(mine | (F.col("_batch") < 0) if batch == 0 else mine))
        index.create(groups)
        found = index.unseen(groups) if batch == 0 else staged(index.unseen(groups).unionByName(index.better(groups)), "entered")
        index.append(found)
        every = groups if every is None else every.unionByName(groups)
    whole = every.groupBy("digest").agg(F.min_by("keep_id", order("keep_id")).alias("keep_id"), F.sum("group_size").alias("group_size"))
    return settled(whole, index)


def decide(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    seen = staged(marks(docs), "marks")
    groups = register(seen, index) if batches == 1 else register_all(seen, index, batches)
    return attach(seen, groups).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add keep_id and group_size to rows with doc_id and digest.

    The key carries a salt drawn from doc_id, so a digest with a third of all
    rows is spread over SALTS tasks even before Spark splits skewed partitions.
    """
    salted = groups.where(~F.col("alone")).select("digest", F.struct("keep_id", "group_size").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    missing = F.col("found").isNull()
    rows = rows.withColumn("keep_id", F.when(missing, F.col("doc_id")).otherwise(F.col("found.keep_id")))
    return rows.withColumn("group_size", F.when(missing, F.lit(1)).otherwise(F.col("found.group_size")).cast("long")).drop("salt", "found")


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    verdict = decide(docs, index).where("kept").select("doc_id", "text_sha256").distinct()
    if own:
        verdict = staged(verdict, "verdict")
        index.drop()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.lower(F.sha2(normalised(), 256)).alias("sha"))
    return rows.alias("r").join(verdict.alias("v"), F.expr("r.doc_id <=> v.doc_id AND r.sha = v.text_sha256"), "left_semi").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, the second against what the first has entered, in an index of its own that goes afterwards."""
    index = DigestIndex(spark)
    out = staged(decide(table(spark, sf_dir, "documents"), index, 2), "decided")
    index.drop()
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY 1)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.text_sha256
FROM d JOIN w USING (text_sha256)
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {"op1_exact_dedup": ORACLE}
