"""Rows whose key occurs with more than one thing, however many rows a key has.

A task sorts its own rows by key first.  Where a key has two different things
in one task, all its rows there are known to recur; they stay where they are,
and one of them goes on to tell other tasks.  So a key with a third of all rows
sends one row for each BUFFER rows read, and the tasks that rows are dealt to by
key compare neighbours in a sorted stream, in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.llm.common import discard, parts, staged

#: Rows that a task sorts at a time.
BUFFER = 1 << 17


def _stacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(width)])


def _batch(rows: np.ndarray, schema: pa.Schema, *flags: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r).cast(field.type) for r, field in zip(rows, schema, strict=False)] + [pa.array(f) for f in flags], schema=schema)


def recurring(rows: DataFrame, key: str, of: list[str], make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The rows (key, things) whose key occurs with at least two different things.

    A row that is listed again may come back more than once.  Columns are
    whole numbers without nulls.  The result is staged.  If ``make`` is given,
    it makes batches of them (all longs) from those of ``rows``, in the Python
    worker that sorts them.
    """
    names = [key, *of]
    rows = rows if make else rows.select(*names)
    width = len(names)
    types = ["bigint"] * width if make else [f.dataType.simpleString() for f in rows.schema]
    kinds = [pa.int32() if kind == "int" else pa.int64() for kind in types]
    marked_schema = pa.schema([*zip(names, kinds, strict=True), ("sure", pa.bool_()), ("told", pa.bool_())])
    out_schema = pa.schema([*zip(names, kinds, strict=True)])
    ddl = ", ".join(f"{name} {kind}" for name, kind in zip(names, types, strict=True))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            same = rows[0, 1:] == rows[0, :-1]
            other = np.zeros(rows.shape[1], bool)
            other[1:] = same & (rows[1:, 1:] != rows[1:, :-1]).any(axis=0)
            told = np.ones(rows.shape[1], bool)
            told[1:] = ~same
            starts = np.flatnonzero(told)
            sure = np.repeat(np.logical_or.reduceat(other, starts), np.diff(np.append(starts, rows.shape[1])))
            # Equal neighbours are one row.
            keep = told | other
            yield _batch(rows[:, keep], marked_schema, sure[keep], told[keep])

        for batch in make(batches) if make else batches:
            for i in range(0, batch.num_rows, BUFFER):
                part = batch.slice(i, BUFFER)
                held.append(_stacked(part, width))
                size += part.num_rows
                if size >= BUFFER:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = np.empty((width + 1, 0), np.int64), None  # the last row, and the key of the one before it

        def out(found: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = found[:width, found[width] == 0]
            if found.shape[1]:
                yield _batch(found, out_schema)

        for batch in batches:
            both = np.concatenate([held, _stacked(batch, width + 1)], axis=1)
            new = np.ones(both.shape[1], bool)
            new[1:] = (both[:width, 1:] != both[:width, :-1]).any(axis=0)
            both = both[:, new]
            same = both[0, 1:] == both[0, :-1]
            known = np.zeros(both.shape[1], bool)
            known[1:] = same
            known[0] = before is not None and both[0, 0] == before
            known[:-1] |= same
            yield from out(both[:, :-1][:, known[:-1]])
            before = both[0, -2] if both.shape[1] > 1 else before
            held = both[:, -1:]
        if held.shape[1] and before is not None and held[0, 0] == before:
            yield from out(held)

    marked = staged(rows.mapInArrow(mark, f"{ddl}, sure boolean, told boolean"), "marked")
    asked = marked.where("told OR NOT sure").select(*names, F.col("sure").cast("int").alias("sure"))
    dealt = asked.repartition(parts(rows.sparkSession), key).sortWithinPartitions(*names, F.desc("sure"))
    out = staged(marked.where("sure").select(*names).unionByName(dealt.mapInArrow(stream, ddl)), "recurring")
    discard(marked)
    return out
