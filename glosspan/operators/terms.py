"""The terms of texts inside tasks: whole batches of bytes are cut at once.

Texts whose code points all lie below U+0250 (all of Latin) go to Python as they
are; their letters, digits and lower cases are looked up in tables.  The terms
of other texts, or of a tokenizer with a pattern of its own, are made by
:meth:`Tokenizer.terms_of`; what comes out is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glosspan.functions.text import TOKEN, Tokenizer

#: Chunks that are taken apart at once.
ROWS = 512
#: The first code point that the tables leave out.
END = 0x250
#: Those below it whose lower case is longer than two bytes.
LONGER = [c for c in range(END) if len(chr(c).lower()) > 1 or len(chr(c).lower().encode()) > 2]
_OTHERS = rf"[^\x00-\x{{{END - 1:x}}}]|[{''.join(map(chr, LONGER))}]"

_IS = np.array([chr(c) == "_" or unicodedata.category(chr(c))[0] in "LN" for c in range(END)])
_LOW = np.array([ord(chr(c).lower()) if c not in LONGER else c for c in range(END)])
_IS_BYTE = np.append(_IS[:0x80], np.zeros(0x80, bool))
_LOW_BYTE = np.append(_LOW[:0x80], np.arange(0x80, 0x100)).astype(np.uint8)


def sent(tokenizer: Tokenizer, text: str = "text") -> Column:
    """What a task is given of a text, for :func:`lists`."""
    made = tokenizer.terms_of(text)
    if tokenizer.pattern != TOKEN:
        return F.struct(F.lit(None).cast("string").alias("text"), made.alias("terms"))
    plain = (F.octet_length(text) == F.char_length(text)) | ~F.rlike(text, F.lit(_OTHERS))
    return F.struct(F.when(plain, F.col(text)).alias("text"), F.when(~plain, made).alias("terms"))


def lists(column: pa.StructArray, stop: list[str]) -> Iterator[pa.ListArray]:
    """The terms of each row, lower-cased and without stopwords, in runs of ROWS."""
    out = pa.array(stop, pa.string())
    for at in range(0, len(column), ROWS):
        texts, stated = column.slice(at, ROWS).flatten()
        found = _cut(pc.fill_null(texts, ""), out)
        if stated.null_count < len(stated):
            rows = np.arange(len(texts))
            other = stated.is_valid().to_numpy(zero_copy_only=False)
            found = pa.concat_arrays([found, stated.cast(found.type)]).take(pa.array(rows + other * len(rows)))
        yield found


def _cut(texts: pa.Array, out: pa.Array) -> pa.ListArray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word, low = _IS_BYTE[data], _LOW_BYTE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        # All of these are of two bytes.
        code = ((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)
        word[lead] = word[lead + 1] = _IS[code]
        low[lead], low[lead + 1] = 0xC0 | (_LOW[code] >> 6), 0x80 | (_LOW[code] & 0x3F)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = word[first]
    begins = np.flatnonzero(begin)
    ends = np.append(np.cumsum(word)[begins] - 1, np.count_nonzero(word)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(low[word]))
    kept = ~pc.is_in(terms, value_set=out).to_numpy(zero_copy_only=False)
    until = np.append(0, np.cumsum(kept))[np.searchsorted(begins, offsets)]
    return pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), terms.filter(pa.array(kept)))
