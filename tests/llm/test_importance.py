"""Importance resampling against a plain restatement."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

from glosspan.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(FOLD))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for doc, text in docs:
        words, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = collections.Counter(r[:4] for r in order[: percent * len(order) // 100])
    return collections.Counter(r[:4] for r in rows), drawn


def test_resampling(spark, make, awkward, clashing, monkeypatch):
    rng = random.Random(12)
    words = ["The", "cat", "naïve", "日本", "x1", "über-all", "a", "ﬀ", "w" * 300]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "\n", " 😀"]) for _ in range(rng.randint(0, 90)))) for i in range(120)] + [(r[0], r[1]) for r in awkward]
    target = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(5)] + [None, ""]
    table = make(docs)
    for name in clashing:
        table = table.withColumn(name, table.lang)
    rows = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), 20).collect()
    every, drawn = brute(docs, target, 20)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == every
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) > 20
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in ranked) == drawn
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked)
    empty = importance.resample(make([]), spark.createDataFrame([], "text string"))
    assert empty.count() == 0 and importance.resample(make([(1, "a b")]), spark.createDataFrame([], "text string")).first().n_features == 3


def test_a_crc_follows_from_those_of_its_parts():
    rng = random.Random(13)
    for n in [0, 1, 2, 7, 63, 64, 1000, 70_001]:
        left, right = rng.randbytes(rng.randint(0, 9)), rng.randbytes(n)
        crc = np.array([zlib.crc32(left)], np.uint32)
        assert int(importance._mapped(importance.appended(n), crc)[0]) ^ zlib.crc32(right) == zlib.crc32(left + right)
        assert int(importance._spaced(crc)[0]) == zlib.crc32(left + b" ")


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(14)
    text = " ".join(rng.choice(["ab", "c", "défg", "h1"]) + rng.choice(["", ".", " -"]) for _ in range(3000)).lower().encode()
    whole = importance.counted([text])
    for size in (1, 50, 997):
        monkeypatch.setattr(importance, "SLICE", size)
        monkeypatch.setattr(importance, "pieces", lambda data, size=size, real=importance.pieces: real(data, size))
        for a, b in zip(whole, importance.counted([text]), strict=True):
            assert list(a) == list(b)
    starts, of, counts = whole[1:]
    for a, b in zip(importance.unpacked(starts, *importance.packed(starts, of, counts)), (of, counts), strict=True):
        assert list(a) == list(b)
