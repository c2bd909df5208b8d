import hashlib
import math
import random
import re

import xxhash
from tablewright.llm import document_fingerprints as D


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xx(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h) if w is not None else h
    return h


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    hashes = [xx(a, b) for a, b in zip(words, words[1:] + [None])]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows):
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1] or ""), signed(xx(r[1] or "")))
    rows = sorted(rows, key=key)
    fps = [brute_fingerprint(t or "") for _, t in rows]
    like = lambda a, b: round(1.0 if a == b else max(0, math.cos((a ^ b).bit_count() * math.pi / 64)), 9)
    out = []
    for k, (d, t) in enumerate(rows):
        t = t or ""
        other = rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        e = brute_fingerprint(edited)
        near = sum(0 < (fps[k] ^ f).bit_count() <= 3 for f in set(fps))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[k]:016x}", f"{e:016x}", like(fps[k], e), like(fps[k], fps[(k + 1) % len(rows)]), near))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"{a}{k}" for k in range(60) for a in ("wé", "\U0001f600x", "Plain")]
    rows = []
    for k in range(80):
        base = rng.choices(vocab, k=rng.choice([1, 2, 5, 60, 400]))
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            if len(copy) > 50:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((rng.randrange(10**6), " ".join(copy) if rng.random() < 0.8 else "\n " + " \t".join(copy) + "\x0b"))
    rows += [(1, ""), (2, None), (3, " \n"), (None, "a b c d"), (None, "a b c d"), (None, "z"), (7, "one two three four"), (7, "one two three four"), (7, "one two three four"), (7, "other")]
    rows += [(5, "many words " * 70_000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_chars int, copies int").repartition(6)
    got = sorted(((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in D.fingerprints(df).collect()), key=str)
    assert got == brute(rows)


def test_one_row_and_empty(spark):
    df = spark.createDataFrame([(4, "abcdef gh")], "doc_id long, text string")
    row = D.fingerprints(df).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abcdeabcd").hexdigest() and row.near_next == 1.0
    assert D.fingerprints(df.limit(0)).collect() == []


def test_near_counts(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(12):
            w = v
            for _ in range(rng.randrange(1, 5)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    want = {signed(v): n for v in values if (n := sum(0 < (v ^ w).bit_count() <= 3 for w in values))}
    got = D.near_counts(spark.createDataFrame([(signed(v),) for v in values], "fp long"), chunk=4)
    assert {r.fp: r.near for r in got.collect()} == want
