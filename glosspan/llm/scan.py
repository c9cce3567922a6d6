"""Skipping rows of a scan by a bit map that grows with the number of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A map has 2**LEAST to 2**MOST bits (128 KB to 32 MB), at least BITS_EACH a key; more keys are joined instead.
LEAST, MOST, BITS_EACH = 20, 28, 8


def map_bits(keys: int) -> int | None:
    """The power of two of bits for so many keys; None if a map of bounded size would let too much pass."""
    power = max(LEAST, (BITS_EACH * max(keys, 1) - 1).bit_length())
    return power if power <= MOST else None


def bit_map(keys: DataFrame, column: str, power: int) -> np.ndarray:
    """Bit x is set if some key has xxhash64 = x modulo 2**power.

    Spark's bitmap aggregate builds pages of 4 KB; at most 2**(MOST - 15) pages are collected.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(1 << power)) + 1
    pages = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << power) // 8, np.uint8)
    for row in pages.toLocalIterator():
        begin = (row["page"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def marked_by_map(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """What a function in Python is to read, and what gives it the rows whose key is among ``keys``, and a few others that share a bit.

    ``keys`` is a staged table.  A join afterwards makes this exact; the map
    only spares its shuffle most of the rows.  Keys beyond what a map of bounded
    size can tell apart are joined here.  What skips rows and what reads them
    then are one function, so a task has one Python worker for both.
    """
    power = map_bits(keys.count())
    if power is None:
        return rows.join(keys.select(column).distinct().hint("merge"), column, "left_semi").select(rows.columns), lambda batches: batches
    held = rows.sparkSession.sparkContext.broadcast(bit_map(keys, column, power))
    names = rows.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            found = batch.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if found.num_rows:
                yield pa.RecordBatch.from_arrays(found.columns[:-1], names)

    return rows.withColumn("_bit", F.pmod(F.xxhash64(column), F.lit(1 << power))), kept


def kept_by_map(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose key is among ``keys`` (a staged table), and a few others, as by ``marked_by_map``."""
    marked, kept = marked_by_map(rows, keys, column)
    return marked.mapInArrow(kept, rows.schema) if "_bit" in marked.columns else marked
