"""The session this library is tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(app: str = "glosspan", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow transfer; other settings through ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, ``spark.checkpoint.dir``; on a single machine a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="glosspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of rows that go to Python at once, unless the session has a bound of its own.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded size.

    A plan runs after the function that made it has returned, so this is set for
    the session.
    """
    if not spark.conf.get(ARROW, None) or spark.conf.get(ARROW) == "-1":
        spark.conf.set(ARROW, ARROW_BYTES)
