"""Embeddings: embedders, and a cache keyed by model and text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.functions.text import DEFAULT, Tokenizer, content_hash
from glosspan.session import small_batches

DIM = 64
CACHE = "text_sha string, model string, vector array<double>"


class Embedder(Protocol):
    """Anything that gives texts vectors; vectors of different models are never mixed."""

    model: str

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) of rows; a text may go without one."""


def hashed(rows: DataFrame, key: str = "id", text: str = "text", dim: int = DIM, tokenizer: Tokenizer = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector, and the columns ``keep``): a bag of words hashed by md5 into ``dim`` counts.

    A row's terms are counted where they are made; rows without terms have no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % dim for t in terms.dictionary.to_pylist()], np.int64)
            row = pc.list_parent_indices(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.bincount(row * dim + bucket[terms.indices.to_numpy(zero_copy_only=False)], minlength=len(batch) * dim).reshape(-1, dim) if len(row) else np.zeros((len(batch), dim))
            at = np.flatnonzero(found.any(axis=1))
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(found[at].ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[1:]), vector], [key, *keep, "vector"])

    small_batches(rows.sparkSession)
    listed = rows.select(tokenizer.terms_of(text).alias("_terms"), key, *keep)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return listed.mapInArrow(run, f"{schema}, vector array<double>")


class Hashed:
    """The offline embedder: hashed bags of words."""

    def __init__(self, dim: int = DIM, tokenizer: Tokenizer = DEFAULT):
        self.dim, self.tokenizer, self.model = dim, tokenizer, f"hashed-{dim}"

    def embed(self, rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        return hashed(rows, key, text, self.dim, self.tokenizer)


def missing(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The distinct texts that the cache (text_sha, model, vector) lacks for this model."""
    keyed = texts.select(content_hash("text").alias("text_sha"), "text").dropDuplicates(["text_sha"])
    return keyed.join(cache.where(F.col("model") == model).select("text_sha"), "text_sha", "left_anti")


def cached(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors of all texts, and the rows to append to the cache; only texts that it lacks are embedded."""
    new = embedder.embed(missing(texts, cache, embedder.model), "text_sha", "text").select("text_sha", F.lit(embedder.model).alias("model"), "vector")
    known = cache.where(F.col("model") == embedder.model).select("text_sha", "model", "vector").unionByName(new)
    return texts.withColumn("text_sha", content_hash("text")).join(known, "text_sha", "left"), new
