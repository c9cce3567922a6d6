"""The pipeline against its stages restated in plain Python."""

import hashlib
import random
import zlib

import corpus_pipeline
from glosspan.llm import language
from glosspan.llm.common import staged

from .test_brute_force import brute_components, brute_hits, sha, widened


def test_stages(spark, make, tmp_path):
    rng = random.Random(12)
    parts = {"en": ["the", "ing", "th", "sh", "ou"], "de": ["sch", "ung", "ü", "der", "ei"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, rng.randint(20, 60)), lang, rng.choice("ab")) for i, lang in enumerate(["en", "de"] * 60)]
    items = [(0, text("en", 14)), (1, text("de", 12))]
    rows += [(200, rows[3][1] + " \n", "de", "a"), (201, "x " + items[0][1], "en", "b"), (202, "123 !!", "en", "a"), (203, None, None, None), (204, "", "en", "a")]
    near = rows[5][1].split()
    near[1] = "other"
    rows.append((205, " ".join(near), "de", "b"))
    docs = make(rows)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, left = docs, {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = staged(stage(spark, now, folder), "stage")
        assert now.columns == docs.columns
        if name == "language ID":
            left = {i: r for i, r in left.items() if i not in (202, 203, 204)}
        elif name == "exact dedup":
            best = {}
            for i, r in left.items():
                key = sha("".join(r[1].split()))
                best[key] = min(best.get(key, (0, 0)), (-len(r[1]), i))
            left = {i: left[i] for _, i in best.values()}
        elif name == "n-gram Jaccard join":
            heads = {i for i, _, c in brute_components(list(left.values()), 5, 80) if i == c}
            left = {i: left[i] for i in heads}
        else:
            clean = {k[0] for k in brute_hits(list(left.values()), items) if not k[-1]}
            left = {i: left[i] for i in clean}
        assert {r.doc_id for r in now.collect()} == set(left), name
    mixed = corpus_pipeline.STAGES[4][1](spark, now, folder).collect()
    assert {r.doc_id for r in mixed} <= set(left) and all(0 < r.taken <= 2 * r["size"] and r.n_slots for r in mixed)
    assert sum(r.taken for r in mixed) == sum(round(t) for t in {r.source: r.target for r in mixed}.values())
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, folder).collect()} == {(r.doc_id, r.taken) for r in mixed}


def test_language_stage_rejects_what_it_does_not_know(spark, make):
    rng = random.Random(31)
    parts = {"en": ["the", "ing", "th", "sh", "ou"], "de": ["sch", "ung", "ü", "der", "ei"], "xx": ["zky", "vow", "qaj", "thu", "ix"]}
    text = lambda p: " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(40))
    rows = [(i, text(parts[lang]), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500 + i, text(parts["xx"]), None) for i in range(20)]
    rows += [(600 + i, text("abcdefghijklmnopqrstuvwxyz") + " the", None) for i in range(20)]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, make(rows), "").collect()}
    assert kept == set(range(120))


def test_language_stage_keeps_many_related_languages(spark, make):
    rng = random.Random(32)
    new = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(n)]
    common = [new(6) for _ in range(4)]
    parts = {f"l{k:02}": new(1) + common[k % 4] for k in range(16)}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate([*parts] * 12)]
    assert corpus_pipeline.identify_language(spark, make(rows), "").count() == len(rows)


def test_language_stage_learns_from_all_training_texts(spark, make, monkeypatch):
    """Words of a few texts count, wherever these would stand in a sample's order; counts that are added up early are the same."""
    rng = random.Random(33)
    few = [f"{a}{b}q" for a in ("vow", "zky", "jix", "wuk") for b in ("or", "ul", "em", "ip")]
    ids = sorted((i for i in range(2300) if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: hashlib.md5(str(i).encode()).digest())
    rows = [(i, " ".join(rng.choice(["the", "ing", "thou", "shing"]) for _ in range(40)), "en") for i in ids[:-12]]
    rows += [(i, " ".join(rng.choice(few) for _ in range(40)), "en") for i in ids[-12:]]
    rows += [(5000 + i, " ".join(rng.choice(["sch", "ung", "über", "deri"]) for _ in range(40)), "de") for i in range(40)]
    assert len(ids) > language.PER_LANGUAGE + 100
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, make(rows), "").collect()}
    assert kept == {r[0] for r in rows}
    whole = language.fit(make(rows)).tables
    monkeypatch.setattr(language, "TOGETHER", 100)
    assert (whole == language.fit(make(rows)).tables).all()


def test_usual_share_is_that_of_all_rows(spark):
    rows = [("en", "en", i / 4096) for i in range(1000, 1200)] + [("en", "de", 0.0)] * 50 + [("de", "de", 0.5)]
    found = spark.createDataFrame(rows, "lang string, lang_pred string, known double")
    assert language.usual_share(found) == {"en": 1010 / 4096, "de": 0.5}


def test_stages_take_odd_tables(spark, make, awkward, clashing, tmp_path):
    """Nulls, repeated rows, clashing columns, long texts and empty tables go through every stage."""
    folder = str(tmp_path)
    spark.createDataFrame([(0, None), (1, ""), (None, "one two")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = {r[0] for r in awkward}
    for docs in (widened(make(awkward), clashing), widened(make([]), clashing)):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:4]:
            now = staged(stage(spark, now, folder), "odd")
            assert now.columns == docs.columns, name
            assert {r.doc_id for r in now.select("doc_id").collect()} <= ids, name
        mixed = corpus_pipeline.STAGES[4][1](spark, now, folder)
        assert {"doc_id", "taken", "target"} <= set(mixed.columns) and all(r.taken > 0 for r in mixed.select("taken").collect())
