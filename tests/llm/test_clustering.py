"""Clustering against a plain Lloyd in Python's integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from glosspan.llm import clustering


def brute(rows, k, rounds, dimensions):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    named = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                centres[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    of = assign()
    far = [apart(v, centres[o]) for (_, v), o in zip(kept, of, strict=True)]
    inertia = collections.Counter()
    for o, d in zip(of, far, strict=True):
        inertia[o] += d
    return collections.Counter((i, o, d, inertia[o], sum(far), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, of, far, strict=True))


@pytest.mark.parametrize(("k", "dimensions", "block"), [(8, 64, clustering.BLOCK), (3, 2, 16), (40, 3, 50)])
def test_clustering(spark, monkeypatch, k, dimensions, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = random.Random(k)
    centres = [[rng.uniform(-2, 2) for _ in range(dimensions)] for _ in range(5)]
    rows = [(i, [round(x + rng.gauss(0, 0.3), 3) for x in rng.choice(centres)]) for i in range(150)]
    same = [0.25] * dimensions
    rows += [(200 + i, same) for i in range(60)] + [(5, same), (5, same), (None, [-1.0] * dimensions)]
    rows += [(300, None), (301, []), (302, [1.0]), (303, [math.nan] * dimensions), (304, [math.inf] * dimensions), (305, [None] * dimensions), (306, [1.0] * (dimensions + 1))]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    got = clustering.cluster(table, k, 10, dimensions)
    assert collections.Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute(exact, k, 10, dimensions)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [1e30] * 64)], schema)
    assert {(r.vec_id, r.cluster, r.distance) for r in clustering.cluster(few).collect()} == {(1, 0, 0), (2, 0, 0)}


def test_trees_find_the_nearest_with_few_comparisons():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, d, k, span = int(rng.integers(1, 200)), int(rng.integers(1, 6)), int(rng.integers(1, 9)), int(rng.choice([2, 5, 50, 5000, 1 << 27]))
        x, c = rng.integers(-span, span + 1, (n, d)), rng.integers(-span, span + 1, (k, d))
        if trial % 3 == 0:
            x[: n // 2] = x[0]
            c[-1] = c[0]
        order, tree = clustering.cover_tree(x, 1 + trial % 9)
        assert sorted(order) == list(range(n))
        for i, point in enumerate(tree.point):
            inside = x[order][tree.begin[i] : tree.end[i]]
            assert np.sqrt(((inside - x[order][point]).astype(float) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9) + 1e-6
        number, over = clustering.cover_tree(c, 1)
        owner, _ = clustering.nearest(tree, x[order], over, c[number], number)
        assert (owner == ((x[order][:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    x = np.repeat(rng.integers(-9000, 9000, (8, 16)), 60, 0) + rng.integers(-50, 50, (480, 16))
    order, tree = clustering.cover_tree(x)
    number, over = clustering.cover_tree(x[::60], 1)
    _, compared = clustering.nearest(tree, x[order], over, x[::60][number], number)
    assert compared < 480 * 8 / 10
