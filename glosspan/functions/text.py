"""Text functions as Column expressions.

``TOKEN`` and ``WORD`` are the classes that Python's ``\\w+`` and ``\\S+`` mean,
written so that Java's and RE2's engines agree with them.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glosspan.functions.stopwords import STOPWORDS

TOKEN = r"[\p{L}\p{N}_]+"
WORD = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Tokenizer:
    """What counts as a term: a pattern, and words that are left out.  Replaceable wherever terms are made."""

    def __init__(self, pattern: str = TOKEN, stopwords: tuple[str, ...] | list[str] = STOPWORDS):
        self.pattern, self.stopwords = pattern, list(stopwords)
        self._stop = frozenset(stopwords)
        self._python = re.compile(r"\w+" if pattern == TOKEN else pattern)

    def terms(self, text: str) -> list[str]:
        """The terms of a query, on the driver."""
        return [t for t in (m.lower() for m in self._python.findall(text)) if t not in self._stop]

    def raw(self, text: str | Column) -> Column:
        return F.regexp_extract_all(col(text), F.lit(f"({self.pattern})"), 1)

    def terms_of(self, text: str | Column) -> Column:
        """Lower-cased terms without stopwords, in text order."""
        return F.filter(F.transform(self.raw(text), F.lower), self.keeps)

    def keeps(self, token: Column) -> Column:
        """Whether a lower-cased token is no stopword; after an explode this stays in generated code."""
        return ~token.isin(self.stopwords) if self.stopwords else F.lit(True)


#: Hits that a highlight gathers before it copies them on.
RUN = 64
DEFAULT = Tokenizer()
tokenize, raw_tokens, tokens, is_term = DEFAULT.terms, DEFAULT.raw, DEFAULT.terms_of, DEFAULT.keeps


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"({WORD})"), 1)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(col(text), F.lit(WORD))


def content_hash(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def web_address(source: str) -> bool:
    """:func:`is_url` for one source on the driver."""
    return source.lower().startswith(("http://", "https://"))


def is_url(source: str | Column) -> Column:
    low = F.lower(col(source))
    return F.startswith(low, F.lit("http://")) | F.startswith(low, F.lit("https://"))


def suffix(source: str | Column) -> Column:
    """The last suffix of a path's name, lower-cased, with its dot; '' for names such as ``.env`` or ``a.``."""
    name = F.regexp_extract(F.regexp_replace(col(source), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^./\\]+)$", 1))


def file_type(source: str | Column) -> Column:
    found = F.ltrim(suffix(source), F.lit("."))
    return F.when(is_url(source), "web").when(found == "", "other").otherwise(found)


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Code points whose case folding is one other code point, and those that fold to several."""
    one, more = {}, {}
    for code in range(0x80, 0x110000):
        sign = chr(code)
        folded = sign.casefold()
        if folded != sign and not 0xD800 <= code < 0xE000:
            (one if len(folded) == 1 else more)[sign] = folded
    return one, more


@functools.cache
def _folding_text() -> tuple[str, str, list[tuple[str, str]]]:
    one, more = _foldings()
    return "".join(one), "".join(one.values()), list(more.items())


def casefolded(text: str | Column) -> Column:
    """Unicode's full case folding: letters that differ only in case are equal, also ``ß`` and ``SS``, and both small sigmas.

    The rules come from Python's; only texts beyond ASCII ask for them.
    """
    before, after, several = _folding_text()
    text = col(text)
    ascii_only = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in several])
    spelled = F.when(F.rlike(text, F.lit("[" + "".join(a for a, _ in several) + "]")), F.aggregate(pairs, ascii_only, lambda s, p: F.replace(s, p["a"], p["b"]))).otherwise(ascii_only)
    return F.when(F.rlike(text, F.lit("[^\\x00-\\x7f]")), F.translate(spelled, before, after)).otherwise(ascii_only)


#: What stripping takes off the ends of a source or pattern.
_ENDS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def normalized(source: str | Column) -> Column:
    """Trimmed, with forward slashes, case folded: :func:`glosspan.operators.filters._folded` does the same to a pattern on the driver."""
    return casefolded(F.replace(F.btrim(col(source), F.lit(_ENDS)), F.lit("\\"), F.lit("/")))


def path_segments(source: str | Column) -> Column:
    """``/a/b/``: the non-empty segments between single slashes."""
    return F.concat(F.lit("/"), F.array_join(F.array_remove(F.split(col(source), "/"), ""), "/"), F.lit("/"))


def source_matches(source: str | Column, label: str | Column) -> Column:
    """Whether ``label`` is the path or a trailing part of it."""
    path = F.replace(col(source), F.lit("\\"), F.lit("/"))
    wanted = F.regexp_replace(F.replace(col(label), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return (wanted != "") & ((path == wanted) | F.endswith(path, F.concat(F.lit("/"), wanted)))


def chunk_id(source: str | Column, position: str | Column) -> Column:
    return F.concat(F.substring(F.sha1(col(source)), 1, 10), F.lit("-"), col(position).cast("string"))


@functools.cache
def _running() -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def sums(lists: pa.Array) -> pa.Array:
        flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(flat)])
        made = (total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(made), mask=lists.is_null())

    return sums


def running(lists: Column) -> Column:
    """Running sums of an ``array<int>``, in one pass: an aggregate that appends copies what it has at every step."""
    return _running()(lists)


def page_at(offsets: str | Column, offset: Column) -> Column:
    """The page (from 1) that holds an offset; null without pages."""
    pages = col(offsets)
    return F.when(F.size(pages) > 0, F.greatest(F.lit(1), F.size(F.filter(pages, lambda o: o <= offset))))


def page_offsets(pages: str | Column) -> Column:
    """Where each page starts once pages are joined by a blank line."""
    before = F.concat(F.array(F.lit(0)), F.transform(col(pages), lambda p: F.char_length(p) + 2))
    return running(F.slice(before, 1, F.size(col(pages))))


def citation(source="source", section="section", first="first_page", last="last_page") -> Column:
    source, section, first, last = map(col, (source, section, first, last))
    paged = F.when(first == last, F.concat(source, F.lit(", p. "), first)).otherwise(F.concat(source, F.lit(", pp. "), first, F.lit("-"), last))
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(source, F.lit(", "), section)).when(first.isNull(), source).otherwise(paged)


def highlights(text: str | Column, terms: list[str], tokenizer: Tokenizer = DEFAULT) -> Column:
    """``array<struct<start,end,term>>``: every word of the text that is one of the terms.

    Offsets count code points, ends exclusive: running sums of the lengths of
    words and of the gaps between them.
    """
    text = col(text)
    wanted = F.array(*map(F.lit, sorted(set(terms)))).cast("array<string>")
    found = F.transform(tokenizer.raw(text), lambda t: F.struct(F.lower(t).alias("term"), F.char_length(t).alias("size")))
    gaps = F.transform(F.split(text, tokenizer.pattern), F.char_length)
    paired = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, w: F.struct(g.alias("gap"), w["size"].alias("size"), F.when(F.array_contains(wanted, w["term"]), w["term"]).alias("term")))
    empty = F.array().cast("array<struct<start:int,end:int,term:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("some"), F.array().cast("array<array<struct<start:int,end:int,term:string>>>").alias("all"))

    def step(s: Column, piece: Column) -> Column:
        start = s["at"] + piece["gap"]
        hit = F.array(F.struct(start.alias("start"), (start + piece["size"]).alias("end"), piece["term"].alias("term")))
        some = F.when(piece["term"].isNotNull(), F.concat(s["some"], hit)).otherwise(s["some"])
        full = F.size(some) >= RUN  # hits are gathered in runs, so that appending copies a run, not all
        return F.struct((start + piece["size"]).alias("at"), F.when(full, empty).otherwise(some).alias("some"), F.when(full, F.concat(s["all"], F.array(some))).otherwise(s["all"]).alias("all"))

    return F.aggregate(paired, state, step, lambda s: F.concat(F.flatten(s["all"]), s["some"]))


def matched_terms(found: str | Column) -> Column:
    return F.array_distinct(F.transform(col(found), lambda h: h["term"]))


def emphasized(text: str | Column, found: str | Column, before: str = "**", after: str = "**") -> Column:
    """The text with its spans marked; overlapping or outlying spans are left out."""
    text = col(text)
    ordered = F.array_sort(col(found))

    def step(s: Column, h: Column) -> Column:
        fits = (h["start"] >= s["at"]) & (h["end"] <= F.char_length(text)) & (h["start"] < h["end"])
        gap = F.substring(text, s["at"] + 1, h["start"] - s["at"])
        inside = F.substring(text, h["start"] + 1, h["end"] - h["start"])
        return F.struct(F.when(fits, h["end"]).otherwise(s["at"]).alias("at"), F.when(fits, F.concat(s["out"], gap, F.lit(before), inside, F.lit(after))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def passage_span(text: str | Column, passage: str | Column) -> Column:
    """``struct<start,end>`` of a passage whose words stand in the text with any white space between; else null."""
    parts = words(passage)
    quoted = F.transform(parts, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.array_join(quoted, "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+")
    at, found = F.regexp_instr(col(text), pattern), F.regexp_substr(col(text), pattern)
    # The instruction counts from 1; code points before the match give the offset.
    return F.when((F.size(parts) > 0) & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.char_length(found)).alias("end")))


def descriptive(term: str | Column) -> Column:
    return (F.char_length(col(term)) >= 3) & ~F.rlike(col(term), F.lit(r"^\p{Nd}+$"))


def preview(text: str | Column, size: int = 400) -> Column:
    flat = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.char_length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("..."))).otherwise(flat)


def plural(count: str | Column, noun: str) -> Column:
    count = col(count)
    return F.when(count == 1, F.concat(count, F.lit(f" {noun}"))).otherwise(F.concat(count, F.lit(f" {noun}s")))


def human_size(size: str | Column) -> Column:
    size = col(size)
    kb, mb = size / 1024, size / (1024 * 1024)
    return F.when(size < 1024, F.concat(size, F.lit(" B"))).when(kb < 1024, F.concat(F.format_string("%.1f", F.bround(kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(mb, 1)), F.lit(" MB")))


def indexed_label(stamp: str | Column) -> Column:
    stamp = col(stamp)
    moment = F.try_to_timestamp(stamp)
    return F.when(stamp == "", "unknown").when(moment.isNull(), stamp).otherwise(F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm"), F.lit(" UTC")))


def usage_summary(model, input_tokens, cached, output_tokens, cost) -> Column:
    model, input_tokens, cached, output_tokens, cost = map(col, (model, input_tokens, cached, output_tokens, cost))
    known = F.when(cached > 0, F.format_string(" (%,d cached)", cached)).otherwise("")
    priced = F.when(cost.isNotNull(), F.format_string(", ~$%.4f", cost)).otherwise("")
    return F.concat(model, F.lit(": "), F.format_string("%,d input tokens", input_tokens), known, F.format_string(", %,d output tokens", output_tokens), priced)


def percent_encoded(text: Column) -> Column:
    """URL encoding with spaces as %20 and dashes encoded, as text fragments need."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("-"), F.lit("%2D")), F.lit("*"), F.lit("%2A"))


def text_directives(text: str | Column, found: str | Column, edge: int = 6, most: int = 4) -> Column:
    """``text=`` fragments: the passage's range, then its matched words as written."""
    parts = words(text)
    whole = F.concat(F.lit("text="), percent_encoded(F.array_join(parts, " ")))
    ends = F.concat(F.lit("text="), percent_encoded(F.array_join(F.slice(parts, 1, edge), " ")), F.lit(","), percent_encoded(F.array_join(F.slice(parts, -edge, edge), " ")))
    span = F.when(F.size(parts) == 0, F.array().cast("array<string>")).when(F.size(parts) <= 2 * edge, F.array(whole)).otherwise(F.array(ends))
    text = col(text)
    seen = F.array_distinct(F.transform(col(found), lambda h: F.substring(text, h["start"] + 1, h["end"] - h["start"])))
    return F.concat(span, F.transform(F.slice(seen, 1, most), lambda w: F.concat(F.lit("text="), percent_encoded(w))))


def source_href(source: str | Column = "source", page: str | Column = "first_page") -> Column:
    """Where a browser finds a source: a URL as it is, a file by its address and page."""
    source, page = col(source), col(page)
    local = F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(source), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))
    return F.when(is_url(source), source).otherwise(F.concat(local, F.when(page.isNotNull(), F.concat(F.lit("#page="), page)).otherwise("")))


#: Types that a browser opens at a passage; web pages always do.
POINTED_INTO = (".html", ".htm", ".md", ".markdown", ".txt", ".rst")


def passage_href(text: str | Column = "text", found: str | Column = "highlights", source: str | Column = "source", page: str | Column = "first_page") -> Column:
    """A source's address that opens at a passage, where a browser can point into it and nothing else is pointed at."""
    href = source_href(source, page)
    directives = F.array_join(text_directives(text, found), "&")
    fits = (is_url(col(source)) | suffix(source).isin(*POINTED_INTO)) & ~F.contains(href, F.lit("#")) & (directives != "")
    return F.when(fits, F.concat(href, F.lit("#:~:"), directives)).otherwise(href)


def breakdown(contributions: str | Column) -> Column:
    """``a 1.20 + b 0.30``."""
    return F.array_join(F.transform(col(contributions), lambda c: F.concat(c["term"], F.lit(" "), F.format_string("%.2f", c["score"]))), " + ")


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors of equal length; 0 when either has no length."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
