"""What the operators share: reading tables, the shared folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators know: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of rows that go to Python at a time; rows are never split.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded size, unless the session has a bound of its own.

    A plan runs after the function that made it has returned, so this is set for
    the session.
    """
    if not spark.conf.get(ARROW, None):
        spark.conf.set(ARROW, ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only on a single machine (tests) a temporary folder takes its place where
    that is unset; on a cluster nothing else is shared, so it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="glosspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/glosspan/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _kept.add(folder)
    return folder


_kept: set[str] = set()
#: Spark then deletes a plan's shuffle files when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage, so an executor that is lost later costs no
    recomputation of what came before; the shuffle files of what came before
    are deleted, and Python gets its rows in batches of bounded size.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    small_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


#: A lookup side of at most so many bytes (rows times the stated width) is broadcast.
BROADCAST_BYTES = 32 << 20


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether a staged table is proven to fit a broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


#: Words of 64 bits in a key map: 1 MB, whatever the number of keys.
MAP_WORDS = 1 << 17


def may_hold(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key may be among the side's: a bit map of fixed size spares a shuffle most of the others.

    The map is one row that every task gets; reading it is an array access in
    generated code.
    """
    key = F.pmod(F.xxhash64(*on), F.lit(MAP_WORDS * 64))
    bits = side.select(key.alias("_k")).selectExpr("cast(_k div 64 AS int) AS word", "shiftleft(1L, cast(_k % 64 AS int)) AS bit")
    words = [0] * MAP_WORDS
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        words[row["word"]] = row["bits"]
    one = rows.sparkSession.createDataFrame([(words,)], "_map array<long>")
    met = rows.withColumn("_k", key).join(F.broadcast(one))
    return met.where("shiftright(_map[cast(_k div 64 AS int)], cast(_k % 64 AS int)) & 1 = 1").drop("_k", "_map")


def lookup(rows: DataFrame, side: DataFrame, on: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """Join a staged side: by broadcast where its counted size allows that, else by sort-merge.

    Before a sort-merge inner join, a key map drops the rows that cannot meet
    any; both exchanges are left to Spark, which splits skewed partitions.
    """
    if small_enough(side, row_bytes):
        return rows.join(F.broadcast(side), on, how)
    return (may_hold(rows, side, on) if how == "inner" else rows).join(side.hint("merge"), on, how)
