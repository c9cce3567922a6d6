"""Secret scans with an incremental blob ledger.

A blob is a distinct text, addressed by its SHA-256.  The ledger records which
(blob, rule version) pairs have been scanned; a run reduces its input to
distinct blobs, drops the pairs the ledger has (a sort-merge anti-join), scans
only the rest, enters pairs and findings, and joins the findings back to every
path (here: document) that holds the blob.  A new rule version scans every blob
once more; a new path of an old blob costs a join.

Both tables lie in the warehouse.  Findings hold only blobs with a span.

Defined results: a null text is the empty blob; offsets count code points of
the whole text; repeated rows repeat their result; a null doc_id is a path like
any other; an empty table gives an empty result; columns other than doc_id and
text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspan.llm.common import crc_mod, staged, table, text_or_empty
from glosspan.llm.scan import kept_by_map

RULE_VERSION = 1
SALTS = 16
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "private_key", "service_token", "web_token")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more is the whole run, as a run of any length would be.
HEX = re.compile(r"[0-9a-f]{32,}")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
SERVICE = re.compile(r"(?a)\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})")
#: Only where a run begins, so that a run is read once.
WEB = re.compile(r"(?a)(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), "private_key", m.end()) for m in PRIVATE.finditer(text)]
    if "_" in text or "-" in text or "AIza" in text:
        found += [(m.start(), "service_token", m.end()) for m in SERVICE.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), "web_token", m.end()) for m in WEB.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def listed(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = spans(text)
            base = [x for x in found if x[1] in BASE]
            rows.append((blob, *(sum(x[1] == kind for x in base) for kind in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


class BlobLedger:
    """Scanned (blob, rule_version) pairs and the findings of blobs that have any.

    Give it a ``name`` to keep it from run to run.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.name = name or f"blob_ledger_{uuid.uuid4().hex}"
        self.findings = f"{self.name}_findings"

    def unseen(self, blobs: DataFrame, rule_version: int) -> DataFrame:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (blob BINARY, rule_version INT) USING parquet")
        seen = self.spark.table(self.name).where(F.col("rule_version") == rule_version).select("blob")
        return blobs.join(seen.hint("merge"), "blob", "left_anti")

    def enter(self, scanned: DataFrame, found: DataFrame, rule_version: int) -> None:
        """Findings first: a pair counts as scanned only when its findings are there."""
        version = F.lit(rule_version).alias("rule_version")
        found.select("*", version).write.mode("append").saveAsTable(self.findings)
        scanned.select("blob", version).write.mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        for name in (self.name, self.findings):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def found(self, rule_version: int) -> DataFrame:
        """Findings; a run that broke off between the two writes may have left equal rows."""
        rows = self.spark.table(self.findings).where(F.col("rule_version") == rule_version)
        return rows.drop("rule_version").dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: BlobLedger, rule_version: int = RULE_VERSION) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, digest of the base spans, spans.

    Texts are scanned where they lie: a bit map of the documents that hold an
    unseen blob for all its copies skips the others, and only findings, which
    few texts have, are dealt out by blob.
    """
    marks = staged(docs.select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("blob")), "blobs")
    blobs = marks.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    todo = staged(ledger.unseen(blobs, rule_version), "unseen")
    held = kept_by_map(docs.select(F.col("doc_id").cast("long").alias("holder"), text_or_empty().alias("text")), todo.select(F.col("holder").cast("long").alias("holder")), "holder")
    found = held.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text").mapInArrow(_batches, FINDINGS).where("spans <> ''")
    found = staged(found.join(todo.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]), "scanned")
    ledger.enter(todo, found, rule_version)
    # A blob with a third of all documents is spread over SALTS tasks.
    salted = ledger.found(rule_version).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["blob", "salt"], "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return out.select("doc_id", *counts, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches (dealt by a checksum of doc_id), the second beside what the first has entered.

    Blobs that the first batch has scanned are not scanned again.  The ledger is
    the query's own and goes afterwards.
    """
    ledger, docs = BlobLedger(spark), table(spark, sf_dir, "documents")
    later = crc_mod("doc_id", 2) == 1
    out = staged(scan(docs.where(~later), ledger), "found").unionByName(staged(scan(docs.where(later), ledger), "found"))
    ledger.drop()
    return out


def oracle() -> str:
    """Every kind's matches in order with the lengths of what lies between them, as RE2 finds them."""
    words, quoted, value = "password|passwd|secret|token|api_?key", r"""["'']?\x20*[:=]\x20*["'']?""", "[A-Za-z0-9+/_.=-]+"
    rules = [
        ("assign", f"(?i:{words}){quoted}{value}", f"length(regexp_extract(m, '^(?i:{words}){quoted}({value})$', 1)) >= 8"),
        ("access", r"AKIA[A-Z0-9]+", "length(m) >= 16"),
        ("hex", r"[0-9a-f]+", "length(m) >= 32"),
        ("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", "true"),
        ("service_token", r"\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", "true"),
        ("web_token", r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ]
    parts = []
    for place, (kind, pattern, holds) in enumerate(rules):
        skipped = "CASE WHEN m LIKE 'eyJ%' THEN 0 ELSE 1 END" if kind == "web_token" else "0"
        parts.append(rf"""
  SELECT rn, {place} AS place, '{kind}' AS kind, a + {skipped} AS a, a + length(m) AS b FROM (
    SELECT rn, m, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS a FROM (
      SELECT rn, g, ms, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT rn, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS g FROM d) WHERE len(ms) > 0)) WHERE {holds}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT rn, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, place) FILTER (place < 3), '') AS base,
         string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, place) AS spans
  FROM f GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rn)
"""


QUERIES = {"op6_secrets": op6_secrets}
ORACLES = {"op6_secrets": oracle()}
