"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and stops at anchors: at-signs,
plus signs, digits, schemes (``://``, ``www.``) and identifier cues (words such
as "account" or "IBAN", street words).  A deterministic local parser then
expands from the anchor to the boundaries of an e-mail address, an IP address,
a card or phone number, a URL, an account number or a postal address, and
validates it.  Every parser looks at one run of characters around its anchor
and no run is parsed twice, so the work is linear in the text.

Between a cue and its identifier or house number stand at most GAP blanks a
place; how far the identifier itself reaches is up to its own boundary.  Cues
are found in any case.

Defined results: a null text has no spans; offsets count code points of the
whole text, ends exclusive; each row is judged alone, so repeated rows repeat
their result and a null doc_id is none to it; an empty table gives an empty
result; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glosspan.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "address")
#: Cues after which an identifier may stand, and street words beside a house number; matched in any case.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "kontonummer", "compte", "cuenta", "customer id", "licence no", "license no", "tax id", "patient id")
STREET_CUES = (" street", " avenue", " road", " boulevard", " lane", "straße", "strasse", " platz", "rue ", "avenue ", "calle ", "plaza ")

#: Blanks in a row that a cue and its identifier may have between them.
GAP = 40
#: Characters before a street word in which its house number is looked for.
REACH = 80
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED, SPACED = re.compile(r"[0-9.]+"), re.compile(r"[0-9 -]+")
NUMBERS, NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile("[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_TAIL = re.compile(r"[^\s<>\"'`{}|\\^]+")
BLANKS = f"[ \\t]{{0,{GAP}}}"
IDENTIFIER = re.compile(rf"{BLANKS}(?:no\.?|number|nr\.?|id|#)?{BLANKS}[:#=]?{BLANKS}([A-Za-z0-9][A-Za-z0-9-]{{4,33}})(?![A-Za-z0-9])", re.I)
IBAN = re.compile(rf"{BLANKS}[:#=]?{BLANKS}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{10,30}})(?![A-Za-z0-9])")
STREET_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?,? (?:[^\W\d_][\w'.-]* ){0,3}[^\W\d_][\w'.-]*\Z")
STREET_AFTER = re.compile(r"(?:[^\W\d_][\w'.-]{0,40} ?){0,4}[ ,]{1,2}[0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z])")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    words = {"@": "email", "+": "phone", "://": "url", "www.": "www"} | {str(d): "digit" for d in range(10)}
    for kind, cues in (("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        words |= dict.fromkeys(cues, kind)
    for word, kind in words.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def addresses(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Addresses in a run of digits and dots: of numbers with single dots between them, every four from the left."""
    out = []
    for m in NUMBERS.finditer(text, a, b):
        parts = [p.span() for p in NUMBER.finditer(text, *m.span())]
        for i in range(0, len(parts) - 3, 4):
            if all(len(text[x:y].lstrip("0")) <= 3 and int(text[x:y].lstrip("0") or "0") <= 255 for x, y in parts[i : i + 4]):
                out.append((parts[i][0], parts[i + 3][1]))
    return out


def iban_holds(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _left(text: str, at: int, stop: int, allowed: frozenset) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def spans(text: str | None, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of each kind, by start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not text:
        return found
    email_end = dotted_end = spaced_end = url_end = account_end = address_end = 0
    digits = frozenset("0123456789")
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when they are lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (kind, length) in anchors.iter(low):
        if kind == "digit":
            if last >= dotted_end:
                a = _left(text, last, dotted_end, digits | {"."})
                dotted_end = DOTTED.match(text, last).end()
                found["ip"] += addresses(text, a, dotted_end)
            if last >= spaced_end:
                spaced_end = SPACED.match(text, last).end()  # the first digit of its run: what is left of it holds none
                for m in CARD.finditer(text, last, spaced_end):
                    number = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(number) <= 19 and luhn(number):
                        found["card"].append(m.span())
        elif kind == "email":
            a = _left(text, last, email_end, LOCAL)
            if a < last and (m := DOMAIN.match(text, last + 1)):
                found["email"].append((a, m.end()))
                email_end = m.end()
        elif kind == "phone":
            if (m := PHONE.match(text, last)) and 8 <= sum(c in digits for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif kind in ("url", "www"):
            first = last - length + 1
            if first < url_end:
                continue
            if kind == "url":
                begin = max((first - len(s) for s in ("https", "http", "ftps", "ftp") if text[max(url_end, first - len(s)) : first].lower() == s), default=None, key=lambda x: -x)
            else:
                begin = first if first == 0 or not text[first - 1].isalnum() else None
            if begin is not None and (m := URL_TAIL.match(text, last + 1)):
                tail = m[0].rstrip(".,;:!?)]")
                if "." in tail:
                    found["url"].append((begin, last + 1 + len(tail)))
                url_end = m.end()
        elif kind == "account":
            if last < account_end or (last + 1 < len(text) and text[last + 1].isalpha()):
                continue
            if (m := IBAN.match(text, last + 1)) and iban_holds(m[1]):
                found["iban"].append(m.span(1))
                account_end = m.end()
            elif (m := IDENTIFIER.match(text, last + 1)) and sum(c in digits for c in m[1]) >= 4:
                found["account"].append(m.span(1))
                account_end = m.end()
        elif last >= address_end:
            first = last - length + 1
            before = STREET_BEFORE.search(text, max(address_end, first - REACH), first)
            if before:
                found["address"].append((first - len(before[0]), last + 1))
                address_end = last + 1
            elif m := STREET_AFTER.match(text, last + 1):
                a = _left(text, first, address_end, frozenset("abcdefghijklmnopqrstuvwxyzäöüßéèABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ"))
                found["address"].append((a + (text[a] == " "), m.end()))
                address_end = m.end()
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    for batch in batches:
        found = [spans(text, anchors) for text in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id")]
        columns += [pa.array([len(f[kind]) for f in found], pa.int64()) for kind in BASE]
        columns.append(pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string()))
        columns.append(pa.array([listed(f, KINDS) for f in found], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans, all spans."""
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(_batches, SCHEMA)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`find` over all documents."""
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
