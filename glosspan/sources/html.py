"""HTML to Markdown-like text, whole pages or their main content.

Markup becomes a tree whose nodes know what they inherit: whether they are
hidden, which heading or preformatted element they belong to, which scopes they
lie in.  The texts of the tree are then chosen by scope and fall into blocks:
all of a heading, all of a preformatted element, or what lies between two line
breaks.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspan.session import small_batches

# Which elements open lines, vanish, or frame the content.
LEVELS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
INVISIBLE = frozenset({"script", "style", "noscript", "template", "svg", "iframe", "object"})
CHROME = frozenset({"nav", "header", "footer", "aside", "form", "dialog"})
LINES = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form header hr li main nav ol p section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset({"td", "th"})
EMPTY = frozenset({"br", "hr"})
SCOPES = ("main", "article")


def squeezed(text: str) -> str:
    return " ".join(text.split())


def block(text: str, level: int = 0) -> str:
    """A heading of that level, or a paragraph; one that would read as a heading gets a backslash."""
    if level:
        return f"{'#' * level} {text}" if text else ""
    marks = len(text) - len(text.lstrip("#"))
    return "\\" + text if 1 <= marks <= 6 and text[marks : marks + 1] in (" ", "\t") else text


@dataclass(eq=False)
class Node:
    """An element with what it takes over from those around it."""

    tag: str
    hidden: bool = False
    title: bool = False
    #: The outermost heading or preformatted element.
    whole: Node | None = None
    scopes: frozenset[str] = frozenset()

    def child(self, tag: str, unseen: frozenset[str]) -> Node:
        hidden = self.hidden or tag in unseen
        node = Node(tag, hidden, self.title or tag == "title", self.whole, self.scopes | {tag} if tag in SCOPES else self.scopes)
        if self.whole is None and (tag in LEVELS or tag == "pre"):
            node.whole = node
        return node


class Tree(HTMLParser):
    """Collects (node, line, text) for every text, in order.

    An end tag closes the nearest open element of its name and all within it;
    from within a hidden element it reaches no further than that element.
    """

    def __init__(self, markup: str, unseen: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.unseen = unseen
        self.open = [Node("")]
        self.places: dict[str, list[int]] = {}
        self.texts: list[tuple[Node, int, str]] = []
        self.line = 0
        self.scopes: set[str] = set()
        self.feed(markup)
        self.close()

    def broken(self, tag: str) -> None:
        if tag in LINES and tag not in self.unseen:
            self.line += 1

    def text(self, data: str) -> None:
        self.texts.append((self.open[-1], self.line, data))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SCOPES:
            self.scopes.add(tag)
        self.broken(tag)
        if tag in EMPTY:
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(self.open[-1].child(tag, self.unseen))
        if tag in CELLS:
            self.text(" ")
        elif tag == "pre":
            self.text("")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.broken(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self.places.get(tag)
        if place and (not self.open[-1].hidden or self.open[place[-1]].hidden):
            while len(self.open) > place[-1]:
                gone = self.open.pop()
                at = self.places[gone.tag]
                if at[-1] == len(self.open):
                    at.pop()
                    if gone.tag == tag:
                        break
        self.broken(tag)

    def handle_data(self, data: str) -> None:
        self.text(data)


@dataclass
class Page:
    text: str
    title: str


def blocks(texts: list[tuple[Node, int, str]], scope: str | None = None) -> list[str]:
    """The blocks of the texts that can be seen in the scope."""
    shown = [(node.whole or line, data) for node, line, data in texts if not (node.hidden or node.title) and (scope is None or scope in node.scopes)]
    out = []
    for whole, run in itertools.groupby(shown, key=lambda pair: pair[0]):
        text = "".join(data for _, data in run)
        if not isinstance(whole, Node):
            out.append(block(squeezed(text)))
        elif whole.tag == "pre":
            code = text.strip("\n")
            out.append(f"```\n{code}\n```")
        else:
            out.append(block(squeezed(text), LEVELS[whole.tag]))
    return [found for found in out if found]


def page(markup: str, unseen: frozenset[str], scopes: tuple[str, ...] = ()) -> Page:
    """The first of the scopes that the page has, if there is text in it, else everything."""
    tree = Tree(markup, unseen)
    scope = next((s for s in scopes if s in tree.scopes), None)
    found = (scope and blocks(tree.texts, scope)) or blocks(tree.texts)
    title = squeezed(" ".join(data for node, _, data in tree.texts if node.title and not node.hidden))
    return Page("\n\n".join(found), title)


def whole(html: str) -> Page:
    return page(html, INVISIBLE)


def main_content(html: str) -> Page:
    """The main element's text, else the articles', else the page's, without its chrome."""
    return page(html, INVISIBLE | CHROME, SCOPES)


def to_text(rows: DataFrame, column: str = "html", main: bool = True) -> DataFrame:
    """Adds text and title, parsed in Arrow batches."""
    small_batches(rows.sparkSession)
    pick = main_content if main else whole

    @F.pandas_udf("struct<text:string,title:string>")
    def parse(pages: pd.Series) -> pd.DataFrame:
        done = [pick(page or "") for page in pages]
        return pd.DataFrame({"text": [p.text for p in done], "title": [p.title for p in done]})

    return rows.withColumn("_page", parse(column)).select("*", F.col("_page.text").alias("text"), F.col("_page.title").alias("title")).drop("_page")
