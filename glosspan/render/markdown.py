"""Markdown and plain-text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosspan.functions import text as T
from glosspan.operators import answers


def _usage(made: answers.Answer) -> str:
    if made.usage is None:
        return ""
    spark = made.passages.sparkSession
    row = spark.createDataFrame([(*made.usage.row(), made.cost_usd)], f"{answers.USAGE}, cost double")
    return row.select(T.usage_summary("model", "input_tokens", "cache_read_tokens", "output_tokens", "cost")).first()[0]


def answer(made: answers.Answer, quote: int = 400) -> str:
    """An answer with linked citations, its passages as footnoted quotes and its documents."""
    rows = made.passages.select("rank", T.citation().alias("cited"), T.source_href().alias("href"), T.preview(T.emphasized("text", "highlights"), quote).alias("text")).orderBy("rank").collect()
    spark = made.passages.sparkSession
    link = lambda n: F.concat(F.lit("[["), n, F.lit("]](#passage-"), n, F.lit(")"))
    text = spark.createDataFrame([(made.text, len(rows))], "text string, n int").select(answers.linked("text", F.col("n"), link)).first()[0]
    lines = [f"# {made.question}", "", text, ""]
    for r in rows:
        lines += [f'<a id="passage-{r["rank"]}"></a>', f"{r['rank']}. [{r['cited']}](<{r['href']}>)", "", f"   > {r['text']}", ""]
    for r in made.documents().select("source", T.indexed_label("indexed_at").alias("at"), F.array_join("ranks", ", ").alias("ranks")).collect():
        lines.append(f"- {r['source']}, indexed {r['at']}, passages {r['ranks']}")
    used = _usage(made)
    return "\n".join([*lines, *(["", used] if used else [])])


def comparison(made: answers.Comparison) -> str:
    """Two answers as plain text."""
    lines = [made.question, f"{len(made.shared)} shared passages, overlap {made.overlap:.2f}"]
    for side in (made.left, made.right):
        lines += ["", f"== {side.label} ==", side.answer.text, *([_usage(side.answer)] if side.answer.usage else [])]
    return "\n".join(lines)
