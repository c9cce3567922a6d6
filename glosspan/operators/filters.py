"""Row predicates: source filters, paths and URLs below a target, unchanged documents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspan.functions.text import col, is_url, normalized, path_segments


def _folded(pattern: str) -> str:
    """A pattern as :func:`normalized` folds sources."""
    return pattern.strip().replace("\\", "/").casefold()


#: What a pattern may be, in the order in which it is asked: a test of the folded pattern, and the predicate over folded sources.
RULES: list[tuple[Callable[[str], bool], Callable[[str, Column], Column]]] = [
    (lambda p: not p, lambda p, source: F.lit(True)),
    (lambda p: p.startswith("."), lambda p, source: F.endswith(source, F.lit(p))),
    (lambda p: p.startswith(("http://", "https://")), lambda p, source: F.startswith(source, F.lit(p))),
    (lambda p: not p.strip("/"), lambda p, source: F.lit(False)),
    (lambda p: True, lambda p, source: F.contains(path_segments(source), F.lit(f"/{re.sub('/+', '/', p.strip('/'))}/"))),
]


def in_scope(pattern: str, source: str | Column = "source") -> Column:
    """Whether a search with this source filter may return the source.

    No pattern: all.  A dot first (or ``*.``): a file type.  An http(s) address:
    a prefix.  Otherwise: consecutive path segments.  Case and the kind of slash
    don't matter.
    """
    wanted = _folded(pattern).lstrip("*")
    return next(made(wanted, normalized(source)) for fits, made in RULES if fits(wanted))


def is_open(pattern: str) -> bool:
    """Whether the filter keeps every source."""
    return not _folded(pattern).lstrip("*")


def under_path(target: str, source: str | Column = "source") -> Column:
    """The target itself or what lies below it; never a URL."""
    source = col(source)
    return ~is_url(source) & ((source == target) | F.startswith(source, F.lit(target.rstrip("/") + "/")))


def under_url(url: str, source: str | Column = "source") -> Column:
    source = col(source)
    return is_url(source) & ((source == url) | F.startswith(source, F.lit(url.rstrip("/") + "/")))


def changed_only(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose (source, content_hash) is not known yet."""
    return documents.join(known.select("source", "content_hash").distinct(), ["source", "content_hash"], "left_anti")


def _hidden_by(folders: list[str], roots: list[str]) -> list[str]:
    """Ignored folders, without those that contain a watched root."""
    bare = [f.rstrip("/") for f in folders]
    return [f for f in bare if not any((root.rstrip("/") + "/").startswith(f + "/") for root in roots)]


def is_ignored(path: str, folders: list[str], roots: list[str]) -> bool:
    return any(path == f or path.startswith(f + "/") for f in _hidden_by(folders, roots))


def ignored(path: str | Column, folders: list[str], roots: list[str]) -> Column:
    """Inside an ignored folder; one that contains a watched root is not ignored."""
    inside = F.lit(False)
    for folder in _hidden_by(folders, roots):
        inside = inside | (col(path) == folder) | F.startswith(col(path), F.lit(folder + "/"))
    return inside
