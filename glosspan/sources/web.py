"""Web pages: fetched bodies to documents.

A fetched page is a row (url, final_url, content_type, charset, body); how it
was fetched is the caller's choice, so no query opens a connection.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

from glosspan.sources import html
from glosspan.sources.files import plain

TIMEOUT, MOST_BYTES = 15, 5_000_000
FETCHED = "url string, final_url string, content_type string, charset string, body binary, failed string"


def decoded(body: bytes, charset: str | None) -> str:
    try:
        return body.decode(codecs.lookup(charset or "utf-8").name, errors="replace")
    except LookupError:
        return body.decode("utf-8", errors="replace")


def parse(content_type: str, charset: str | None, body: bytes) -> tuple[str, str, str]:
    """(text, type, title) by media type; ValueError for others."""
    media = (content_type or "").partition(";")[0].strip().lower()
    if media in ("text/html", "application/xhtml+xml"):
        page = html.main_content(decoded(body, charset))
        return page.text, "html", page.title
    if media in ("text/markdown", "text/x-markdown"):
        return plain(decoded(body, charset).encode()), "markdown", ""
    if media.startswith("text/"):
        return plain(decoded(body, charset).encode()), "text", ""
    raise ValueError(f"unsupported content type {media or 'none'}")


def fetch(url: str) -> tuple[str, str, str | None, bytes]:
    """final URL, content type, charset, body of an http(s) page within the size limit."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not an http(s) address: {url}")
    with urlopen(Request(url, headers={"User-Agent": "glosspan"}), timeout=TIMEOUT) as answer:  # noqa: S310
        body = answer.read(MOST_BYTES + 1)
        if len(body) > MOST_BYTES:
            raise ValueError(f"{url} is larger than {MOST_BYTES} bytes")
        return answer.geturl(), answer.headers.get_content_type(), answer.headers.get_content_charset(), body


def fetched(urls: DataFrame, fetcher: Callable[[str], tuple] = fetch) -> DataFrame:
    """Fetch a column ``url`` on the executors; failures are rows with a reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url in frame["url"]:
                try:
                    out.append((url, *fetcher(url), None))
                except Exception as error:  # noqa: BLE001
                    out.append((url, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["url", "final_url", "content_type", "charset", "body", "failed"])

    return urls.select("url").mapInPandas(run, FETCHED)


def documents(pages: DataFrame) -> DataFrame:
    """source (the URL asked for), text, type, title, final_url, failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    if row["failed"]:
                        raise ValueError(row["failed"])
                    out.append((row["url"], *parse(row["content_type"], row["charset"], bytes(row["body"])), row["final_url"], None))
                except ValueError as error:
                    out.append((row["url"], None, None, None, row["final_url"], str(error)))
            yield pd.DataFrame(out, columns=["source", "text", "type", "title", "final_url", "failed"])

    return pages.mapInPandas(run, "source string, text string, type string, title string, final_url string, failed string")
