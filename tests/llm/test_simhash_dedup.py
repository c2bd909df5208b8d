import random
import re

import numpy as np
import pytest
import xxhash
from tablewright.llm import common
from tablewright.llm import simhash_dedup as S
from tablewright.llm.common import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
    return sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{k}é" for k in range(300)]
    rows = []
    for k in range(60):
        base = rng.choices(vocab, k=rng.choice([1, 3, 4, 30, 300]))
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(base)
            if len(copy) > 20:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n ".join(copy)))
    rows += [(900, ""), (901, None), (902, " \t\n"), (None, "x y z"), (None, "x y z"), (903, "X  Y Z"), (903, "X  Y Z"), (904, "a b c"), (905, "long " * 70000 + "end")]
    df = spark.createDataFrame([(d, t, "s", d) for d, t in rows], "doc_id long, text string, fp string, u long")
    got = sorted((tuple(r)[:3] for r in S.near_duplicates(df, tile=16).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest_spans_all_links():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(12)]))
    a, b = values[::2], values[1::2]

    def classes(pairs):
        lab = {int(v): int(v) for v in values}
        for p, q in pairs:
            x, y = lab[p], lab[q]
            lab = {k: (min(x, y) if v in (x, y) else v) for k, v in lab.items()}
        return lab

    every = [(int(p), int(q)) for p in a for q in b if int(p ^ q).bit_count() <= 4]
    got = S.forest(a, b, 4, False)
    assert classes(got) == classes(every) and len(got) < len(every) and all((p ^ q).bit_count() <= 4 for p, q in got)
    every = [(int(p), int(q)) for p in values for q in values if int(p ^ q).bit_count() <= 4]
    assert classes(S.forest(values, values, 4, True)) == classes(every)


@pytest.mark.parametrize("hot_rows", [10_000, 5])
@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_components_of_chain_and_star(spark, monkeypatch, hot_rows, task_edges):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), task_edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
