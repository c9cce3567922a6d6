"""Tables of the test data as documents, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """source (a path), text, type, seq."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    return read(spark, folder, "documents").select(path.alias("source"), F.coalesce("text", F.lit("")).alias("text"), F.lit("text").alias("type"), F.col("doc_id").alias("seq"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """source (the URL), html, seq."""
    return read(spark, folder, "pages").select(F.col("url").alias("source"), "html", F.col("page_id").alias("seq"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
