import json
import os

from glosspan import cli
from glosspan.engine import Engine
from glosspan.sources.settings import Settings


def corpus(folder):
    folder.mkdir()
    (folder / "install.md").write_text("# Install\nRun the installer with pip.\n## Docker\nPull the image and start a container.\n# Uninstall\nDelete the folder.")
    (folder / "faq.txt").write_text("Which formats work? Markdown and plain text.\n\nWhere is the index? In a folder.")
    (folder / "page.html").write_text("<title>P</title><main><h1>Ranking</h1><p>Passages are ranked by term weights.</main>")
    (folder / "x.bin").write_bytes(b"\x00")
    return str(folder)


def test_service(spark, tmp_path):
    where = corpus(tmp_path / "docs")
    engine = Engine(spark, Settings(index_path=str(tmp_path / "index")), clock=lambda: "2026-01-01T00:00:00+00:00")
    assert engine.search("anything").isEmpty() and engine.remove(where) == 0
    done = engine.index_paths(where)
    assert (done.indexed, done.unchanged, len(done.skipped), done.failed) == (3, 0, 1, [])
    again = engine.index_paths(where)
    assert (again.indexed, again.unchanged) == (0, 3)
    top = engine.search("container image", 1).first()
    assert top.section == "Install > Docker" and set(top.matched_terms) == {"image", "container"}
    assert engine.search("folder", source="*.txt").count() == 1
    text, found = engine.ask("how are passages ranked")
    assert "[1]" in text and found.first().source.endswith("page.html")
    page = engine.source_page(top.id, spark.createDataFrame([(top.source, (tmp_path / "docs/install.md").read_text())], "source string, text string"), "image")
    row = page.first()
    assert row.text[row.passage_start : row.passage_end].split() == top.text.split() and row.text[row.highlights[0].start :].startswith("image")
    assert engine.compare("folder", "retriever=embedding").first().overlap > 0
    cases = spark.createDataFrame([("1", "docker container", ["docs/install.md"])], "query_id string, query string, relevant array<string>")
    assert engine.evaluate(cases, 3)[1].first().mrr == 1.0
    fetched = engine.index_urls("https://e.org/a", "ftp://no", fetcher=lambda u: (u, "text/plain", None, b"remote words"))
    assert fetched.indexed == 2 and engine.remove("https://e.org") == 1
    again = engine.source_page(top.id, query="image").first()
    assert again.text[again.highlights[0].start :].startswith("image") and engine.source_page("unknown").isEmpty()
    hybrid = engine.changed("retriever=hybrid")
    assert hybrid.search("ranked passages", 2).count() == 2
    held = sorted((tmp_path / "index" / "cache" / "vectors").rglob("*.parquet"))
    assert held and hybrid.search("ranked passages", 2).count() == 2 and sorted((tmp_path / "index" / "cache" / "vectors").rglob("*.parquet")) == held

    assert engine.remove(os.path.relpath(where)) == 3


def test_command_line(spark, tmp_path, capsys):
    where, index = corpus(tmp_path / "docs"), str(tmp_path / "index")
    assert cli.main(["--index", index, "index", where]) == 0
    assert cli.main(["--index", index, "search", "installer", "--json"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out[out.index("{\n") :])["results"][0]["chunk"]["section"] == "Install"
    assert cli.main(["--index", index, "search", "zebra"]) == 1
    assert cli.main(["--index", index, "dashboard"]) == 0 and "graph LR" in capsys.readouterr().out
    (tmp_path / "bad.toml").write_text("nope = 1")
    assert cli.main(["--config", str(tmp_path / "bad.toml"), "stats"]) == 2
    assert cli.main(["--index", index, "remove", where]) == 0 and cli.main(["--index", index, "remove", where]) == 1
