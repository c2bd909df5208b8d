import hashlib
import random
import re
from collections import defaultdict

import pytest
from tablewright.llm import source_mixing as M


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        source = rng.choice(["a", "a", "a", "Z", "é", "b", None, "\U0001f600", "￿"])
        rows.append((k, "w x  y\n" * rng.randrange(12), source, "t"))
    rows += [(9000, None, "a", ""), (9001, "", "onlyempty", ""), (None, "p q", "b", ""), (None, "p q", "b", ""), (9007, "same row", "b", ""), (9007, "same row", "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = M.mix(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {d: s for d, _, s, _ in rows}
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((d, words(t)) for d, t, _, _ in rows), key=str)
    for r in got:
        s = by_id[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 50, s
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = M.mix(df.repartition(13, "text")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, None, "s")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in M.mix(df).collect()) == [(1, 3, 3, 4.5, 3), (2, 0, 0, 0.0, 0)]
    assert M.mix(df.limit(0)).collect() == []


def test_very_long_text_and_exact_queue(spark):
    """What the mix takes, told again by one queue of all documents, one of them far longer than the rest."""
    rng = random.Random(6)
    rows = [(k, "w " * rng.randrange(1, 40), rng.choice("abcd")) for k in range(400)] + [(1000, "w " * 400_000, "b")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = brute_targets(sizes)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sent, queue = defaultdict(int), []
    for k in range(2):
        for h, d, t, s in sorted((md5(f"{k}:{d}:{md5(t)}"), d, t, s) for d, t, s in rows):
            sent[s] += words(t)
            queue.append((sent[s] / target[s], h, d, words(t)))
    taken, total = defaultdict(int), 0
    for _, _, d, n in sorted(queue):
        total += n
        if total <= round(sum(target.values()), 6):
            taken[d] += n
    got = {r.doc_id: r.taken for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {d: taken[d] for d, _, _ in rows}
