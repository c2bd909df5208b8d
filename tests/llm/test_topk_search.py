import math
import random
from fractions import Fraction

import numpy as np
from tablewright.llm import topk_search as S


def brute(rows, k=5):
    ok = [(n, i, [math.floor(256 * Fraction(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, j, w in ok if m != n and len(w) == len(v))
            out += [(i, r + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, _, _, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(k, f32([rng.gauss(k % 4, 0.3) for _ in range(5)])) for k in range(700)]
    rows += [(1000 + k, f32([0.5] * 5)) for k in range(300)]
    rows += [(5000, None), (5050, [0.1, None, 1.0, 1.0, 1.0]), (5100, [float("nan")] * 5), (5150, [float("inf")] * 5), (5200, []), (5250, [1.0, 2.0]), (None, f32([9.0] * 5))]
    rows += [(5300, f32([1.0] * 5)), (5300, f32([1.0] * 5)), (5350, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, uid int")
    want = brute(rows)
    for block, small in ((10**6, 10**6), (100, 100)):
        assert sorted(map(tuple, S.top_k(df, block=block, small=small).collect()), key=str) == want
    assert S.top_k(df.limit(0)).collect() == []


def test_clusters_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 16)).astype(float)
    x = np.concatenate([c + rng.integers(-6, 7, (300, 16)) for c in centres])
    s = S.Search(x[::50], x, np.arange(0, len(x), 50), np.arange(len(x)), np.arange(len(x)), 5)
    best = s.run()
    assert s.pairs < 0.5 * len(x[::50]) * len(x)
    scores = x[::50] @ x.T
    scores[np.arange(len(scores)), np.arange(0, len(x), 50)] = -np.inf
    assert [[-f[0] for f in b] for b in best] == np.sort(scores, axis=1)[:, :-6:-1].tolist()


def test_large_components_are_exact(spark):
    """Finite doubles of any size take part, and are ranked by products in whole numbers."""
    rng = random.Random(8)
    sizes = [1.0, 3.0, 1e6, 1e6 + 1, 1e30, 1e30 * (1 + 2**-50), 1e155, 1e308, -1e308, 1.7e308, 5e-324, 0.0, 2.0**53, 2.0**40]
    rows = [(k, [rng.choice(sizes) * rng.choice([1, 1, -1]) for _ in range(4)]) for k in range(300)]
    rows += [(400 + k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    rows += [(1000 + k, [0.0, 0.0, 0.0, float(k)]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, small in ((10**6, 10**6), (100, 50)):
        assert sorted(map(tuple, S.top_k(df, block=block, small=small).collect()), key=str) == brute(rows)


def test_scores_beyond_a_long_sort():
    scores = [-(10**400), -(2**63) - 1, -(2**63), 2**63 - 1, 2**63, 10**19, 10**20 - 1, 10**20, 10**400]
    assert [S.wide(x) for x in scores] == sorted(S.wide(x) for x in scores) and S.wide(2**62) is S.wide(-(2**62)) is None


def test_cover_tree():
    """Nesting, covering and separation, and that nodes cover their rows."""
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(1000, 6)), np.repeat(rng.normal(size=(9, 3)), 50, axis=0), rng.integers(0, 3, (500, 2)).astype(float), np.zeros((40, 4)), rng.normal(size=(1, 3))):
        found = S.index(x, 8)
        apart = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(-1))
        for level in sorted(set(found.levels.tolist())):
            net = found.centres[found.levels >= level]
            if len(net) > 1:
                assert apart(net[:, None], net[None])[~np.eye(len(net), dtype=bool)].min() > S.BASE**level * (1 - 1e-9)
        for j in range(1, len(found.centres)):
            parent = found.parents[j]
            assert found.levels[parent] > found.levels[j] and apart(found.centres[j], found.centres[parent]) <= S.BASE ** (found.levels[j] + 1) * (1 + 1e-9)

        def walk(node):
            assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-12
            if node.children:
                assert sorted(r for c in node.children for r in c.rows) == sorted(node.rows)
                assert (node.children[0].centre == node.centre).all() and all(c.level < node.level for c in node.children)
                for c in node.children:
                    walk(c)
            return node

        assert sorted(walk(S.tree(x, found)).rows) == list(range(len(x)))
