import random

import numpy as np
from tablewright.llm import near_copies as N


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets, comp = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sorted(min((rows[k][0] is None, rows[k][0] or 0) for k in range(len(rows)) if comp[k] == c) for c in set(comp))


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(60):
        base = rng.choices(vocab, k=rng.choice([1, 4, 30, 300]))
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(len(base) * rng.randrange(4) // 100):  # similarity 0.65 to 1, much of it about 0.8
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), ("\n " if k % 3 else " ").join(copy)))
    long = rng.choices(vocab, k=1000)
    rows += [(500, " ".join(long)), (501, " ".join(long[:810])), (502, " ".join(long[:780])), (None, "x y z"), (None, "X  y Z"), (600, ""), (601, None), (602, " \n"), (603, "x " * 70000)]
    docs = spark.createDataFrame([(t, d, "s", d) for d, t in rows], "text string, doc_id long, code string, u long")
    want = brute(rows)
    for sizes in ({"tile": 40, "block": 500}, {}):
        got = N.first_copies(docs, **sizes)
        assert got.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert N.first_copies(docs.limit(0)).collect() == []


def test_stage_drops_similarity_above_the_bound(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:340]))]  # similarity 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == list(range(0, 80, 2))


def test_a_large_group_just_below_the_bound_makes_few_rows():
    """600 sets that mostly share 0.7 to 0.85 of their shingles: the links leave as a forest."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 300)
    sets = [np.unique(np.concatenate([rng.choice(base, 300 - int(n), replace=False), rng.integers(-(2**62), 2**62, n)])) for n in rng.integers(10, 50, 600)]
    size = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    label = list(range(len(sets)))
    for i in range(0, len(sets)):
        for j in range(i):
            if label[i] != label[j] and size(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if c == b else c for c in label]
    found = []
    for a, b in ((0, 0), (0, 1), (1, 1)):
        left, right = N.alike(sets[a::2], sets[b::2], a == b)
        assert len(left) < (300 if a == b else 600)
        assert all(size(sets[a::2][i], sets[b::2][j]) >= 0.8 for i, j in zip(left, right))
        found += [(2 * i + a, 2 * j + b) for i, j in zip(left.tolist(), right.tolist())]
    got = list(range(len(sets)))
    for i, j in found:
        a, b = sorted((got[i], got[j]))
        got = [a if c == b else c for c in got]
    assert got == label and 1 < len(set(label)) < 600
