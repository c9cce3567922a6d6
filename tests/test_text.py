import pytest
from pyspark.sql import functions as F

from glosspan.functions import text as T
from glosspan.operators.filters import in_scope, under_path, under_url


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'array<int>' if isinstance(v, list) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_drop_stopwords_after_lowering(spark):
    assert one(spark, T.tokens("t"), t="The Café's ½ days, não À à 日本_x") == ["café", "s", "½", "days", "não", "日本_x"]
    assert T.tokenize("The Café's ½ days") == ["café", "s", "½", "days"]


def test_highlights_count_code_points(spark):
    found = one(spark, T.highlights("t", ["ação", "ok"]), t="😀 Ação, ok ok-no")
    assert [(h.start, h.end, h.term) for h in found] == [(2, 6, "ação"), (8, 10, "ok"), (11, 13, "ok")]
    marked = one(spark, T.emphasized("t", T.highlights("t", ["ação", "ok"])), t="😀 Ação, ok ok-no")
    assert marked == "😀 **Ação**, **ok** **ok**-no"


@pytest.mark.parametrize(
    ("pattern", "source", "kept"),
    [
        ("", "a/b.md", True),
        (".md", "a/b.MD", True),
        ("*.pdf", "a/b.md", False),
        ("docs", "project/docs/faq.md", True),
        ("docs/api", "docs/guide/api/x.md", False),
        ("DOCS\\api", "x/docs/api/y.md", True),
        ("ocs", "docs/faq.md", False),
        ("/", "a", False),
        ("https://e.org/docs", "https://e.org/docs2", True),
        ("https://e.org", "http://e.org", False),
    ],
)
def test_source_filter(spark, pattern, source, kept):
    assert one(spark, in_scope(pattern, "s"), s=source) is kept


@pytest.mark.parametrize(
    ("source", "kind"), [("a/b.TXT", "txt"), ("https://x.org/a.html", "web"), (".env", "other"), ("a.tar.gz", "gz"), ("dir.x/name", "other"), ("c:\\d.e\\f", "other")]
)
def test_file_type(spark, source, kind):
    assert one(spark, T.file_type("s"), s=source) == kind


def test_paths_and_labels(spark):
    assert one(spark, under_path("a/b", "s"), s="a/b/c.md") and not one(spark, under_path("a/b", "s"), s="a/bc")
    assert one(spark, under_url("https://x/a/", "s"), s="https://x/a/b") and not one(spark, under_url("https://x/a/", "s"), s="https://x/a")
    assert one(spark, T.source_matches("s", "l"), s="x\\docs\\a.md", l="docs/a.md")
    assert not one(spark, T.source_matches("s", "l"), s="docs/a.md", l="/")


def test_passage_span(spark):
    span = one(spark, T.passage_span("t", "p"), t="éa  b\n\tc.d+ e", p="b c.d+")
    assert (span.start, span.end) == (4, 11)
    assert one(spark, T.passage_span("t", "p"), t="abc", p="x") is None
    assert one(spark, T.passage_span("t", "p"), t="abc", p=" ") is None


def test_small_labels(spark):
    assert one(spark, T.human_size("n"), n=512) == "512 B"
    assert one(spark, T.human_size("n"), n=1536) == "1.5 KB"
    assert one(spark, T.indexed_label("s"), s="2026-10-22T09:30:00+00:00") == "2026-10-22 09:30 UTC"
    assert one(spark, T.indexed_label("s"), s="") == "unknown" and one(spark, T.indexed_label("s"), s="soon") == "soon"
    assert one(spark, T.preview("s", 5), s="a  b\ncdefg") == "a b c..."
    assert one(spark, T.page_at("o", F.lit(8)), o=[0, 7, 14]) == 2
    assert one(spark, T.page_offsets(F.array(F.lit("abcde"), F.lit("é"), F.lit("x"))), n=1) == [0, 7, 10]
    usage = T.usage_summary(F.lit("m"), F.lit(1200), F.lit(900), F.lit(85), F.lit(0.0035))
    assert one(spark, usage, n=1) == "m: 1,200 input tokens (900 cached), 85 output tokens, ~$0.0035"


def test_text_directives(spark):
    text = "one two-three four five six seven eight nine ten eleven twelve thirteen fourteen"
    found = one(spark, T.text_directives("t", T.highlights("t", ["two", "ten"])), t=text)
    assert found == ["text=one%20two%2Dthree%20four%20five%20six%20seven,nine%20ten%20eleven%20twelve%20thirteen%20fourteen", "text=two", "text=ten"]
