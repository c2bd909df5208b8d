import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F
from tablewright.llm import sharding as S


def test_shards_and_slots(spark):
    rows = [(k, f"text é {k}" * (k % 7), "x") for k in range(4000)] + [(None, None, "y")] * 3 + [(5, "again", "z")] * 300 + [(9000, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = S.shard(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        home[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in home.values())
    n = Counter(next(iter(x))[0] for x in home.values())
    assert len(n) == 40 and max(n.values()) < 160 and 50 < sum(next(iter(x))[1] == 40 for x in home.values()) < 150


def test_weights(spark):
    df = spark.range(20000).select(S.rendezvous(F.col("id"), [1, 0, 3]).alias("s"), S.rendezvous(F.col("id"), [1, 0, 3, 2]).alias("g"))
    got = Counter(map(tuple, df.collect()))
    assert all(g in (s, 3) for s, g in got)
    assert abs(sum(n for (s, _), n in got.items() if s == 2) - 15000) < 400 and not any(s == 1 for s, _ in got)


def test_one_shard_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in S.shard(df, 1).collect()) == [(0, 0), (0, 1)]
    assert S.shard(df.limit(0)).collect() == []


def test_against_brute_force(spark):
    """The winner by every shard's score, worked out one by one."""
    keys = [0, 1, -5, 2**62, *range(100, 400)]
    weights = [1 + k % 3 for k in range(12)]
    h = lambda x, seed: xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    score = lambda s, w, key: -w / math.log(((h(key, h(s, 42)) >> 12) + 0.5) / 2.0**52)
    win = lambda key, weights: max(range(len(weights)), key=lambda s: (score(s, weights[s], key), -s))
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    for given in (None, weights):
        used = given or [1.0] * 12
        got = {r.doc_id: (r.shard, r.grown_shard) for r in S.shard(docs, 12, given).collect()}
        assert got == {k: (win(k, used), win(k, [*used, 1.0])) for k in keys}


def test_very_long_text(spark):
    text = "é" * 3_000_000
    row = S.shard(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert (row["size"], row.text_crc32) == (6_000_016, zlib.crc32(text.encode()))
