"""Near-duplicate documents by SimHash, found by tiled exact comparison.

Every distinct fingerprint is compared exactly with every other one that can lie within the
radius. Fingerprints are dealt into tiles by the population counts of their two 32-bit halves.
Two fingerprints within ``radius`` bits have halves whose counts differ by at most ``radius`` in
total, so tile pairs further apart than that are never formed. Within a tile pair the same bound
is used once more: both sides are sorted by the counts of their eight bytes and cut into small
tiles, and small tiles whose ranges of counts are too far apart are skipped. What remains is
compared by numpy exclusive-or and bit counts.

A tile pair yields a spanning forest of its links, never all of them, so a group of n near copies
costs n - 1 rows. Tiles hold at most about ``tile`` fingerprints; larger ones are split by hash.
The comparison itself is quadratic in the number of distinct fingerprints, with the small constant
that the two bounds leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lean, small_join, spread_join, text_code

#: Fingerprints in a tile, about.
TILE = 65_536
#: Fingerprints in a small tile within a tile.
SMALL = 64
#: Shingles whose bits are unpacked at once; a multiple of 255, the most that a byte can count.
CHUNK = 255 * 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text, as an unsigned number; 0 for a text without words (or none)."""
    terms = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not terms:
        return 0
    joined = b" ".join(terms)
    if len(terms) <= words:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        ends = np.cumsum(length + 1) - 1
        starts = (ends - length)[: len(terms) - words + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK], axis=1).view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight byte counters in each number
        counts += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], ["doc_id", "code", "fp"])


class _Tiles:
    """A tile sorted by the bit counts of its bytes and cut into small tiles."""

    def __init__(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values)
        lanes = np.bitwise_count(values.view(np.uint8).reshape(-1, 8))
        order = np.lexsort(lanes.T)
        self.values, lanes = values[order], lanes[order].astype(np.int16)
        self.starts = np.arange(0, len(values), SMALL)
        self.low = np.minimum.reduceat(lanes, self.starts, axis=0)
        self.high = np.maximum.reduceat(lanes, self.starts, axis=0)


def spanning(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels once the links from ``left`` to ``right`` have joined them, and the places of links that do so."""
    place, picked = np.arange(len(left)), []
    while True:
        place = place[label[left[place]] != label[right[place]]]
        if not len(place):
            return label, np.array(picked, np.int64)
        # one link for each pair of labels; the rest of them follow from it
        pairs, first = np.unique(np.stack([label[left[place]], label[right[place]]], 1), axis=0, return_index=True)
        parent: dict[int, int] = {}

        def root(k: int, parent: dict[int, int] = parent) -> int:
            while k in parent:
                k = parent[k]
            return k

        for (p, q), k in zip(pairs.tolist(), first.tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                picked.append(int(place[k]))
        new = np.arange(len(label))
        for k in parent:
            new[k] = root(k)
        label = new[label]


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between ``a`` and ``b`` within ``radius`` bits, as a spanning forest of all such links."""
    x = _Tiles(a)
    y = x if same else _Tiles(b)
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    out = []
    for i, start in enumerate(x.starts):
        gap = np.maximum(0, np.maximum(x.low[i] - y.high, y.low - x.high[i])).sum(axis=1)
        near = gap <= radius
        if same:
            near[:i] = False
        if not near.any():
            continue
        columns = np.flatnonzero(np.repeat(near, SMALL)[: len(y.values)])
        rows = x.values[start : start + SMALL]
        found = np.flatnonzero(np.bitwise_count(rows[:, None] ^ y.values[columns][None, :]) <= radius)
        left, right = start + found // len(columns), columns[found % len(columns)] + shift
        label, picked = spanning(label, left, right)
        out += zip(x.values[left[picked]].tolist(), y.values[right[picked] - shift].tolist(), strict=True)
    return out


def _edges(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, int]] = []
        a, b, same = batch.column(0), batch.column(1), batch.column(2)
        for k in range(batch.num_rows):
            x, y = (np.asarray(col[k].values).view(np.uint64) for col in (a, b))
            found += forest(x, y, radius, same[k].as_py())
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v) links between the distinct longs of column ``fp``: a spanning forest in each tile pair."""
    distinct = fps.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("k1"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("k2"))
    # at most 33 * 33 rows
    sizes = distinct.groupBy("k1", "k2").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias("parts"))
    blocks = cut(
        distinct.join(F.broadcast(sizes), ["k1", "k2"])
        .groupBy("k1", "k2", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    reach = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    ids = blocks.select("k1", "k2", "part")
    pairs = (
        ids.withColumn("s", reach)
        .select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("part").alias("a3"), (F.col("k1") + F.col("s.i")).alias("k1"), (F.col("k2") + F.col("s.j")).alias("k2"))
        .join(ids, ["k1", "k2"])
        .where("k1 <> a1 or k2 <> a2 or part >= a3")
    )
    left = blocks.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("part").alias("a3"), F.col("fps").alias("a"))
    right = blocks.select("k1", "k2", "part", F.col("fps").alias("b"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(left, ["a1", "a2", "a3"]).join(right, ["k1", "k2", "part"])
    joined = joined.select("a", "b", F.expr("k1 = a1 and k2 = a2 and part = a3").alias("same"))
    return joined.repartition(n).mapInArrow(lambda batches: _edges(batches, radius), "u long, v long")


def _grouped(docs: DataFrame, words: int, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, code, fp) of each row, and (fp, root) of each distinct fingerprint: its component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_code(F.col("text")).alias("code"), "text")
    fps = cut(texts.mapInArrow(lambda batches: lean(_fingerprints(batches, words)), f"doc_id {kind}, code long, fp long"))
    distinct = cut(fps.select("fp").distinct())
    member = components(links(distinct, radius, tile)).withColumnRenamed("node", "fp")
    return fps, cut(distinct.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def least_rows(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, least) with the least doc_id, null last, and its text's code, in each component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "code"))
    by_fp = fps.groupBy("fp").agg(first.alias("least"))
    return by_fp.join(roots, "fp").groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...): doc_id, fingerprint, component_id.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id that links reach, itself
    included. Other columns of ``docs`` are ignored, whatever their names.

    A null or blank text has fingerprint zero and is linked like any other. A row without doc_id
    gets the component of its fingerprint, null if no member has a doc_id. Repeated rows stay.
    An empty table gives an empty result.
    """
    fps, roots = _grouped(docs, words, radius, tile)
    named = least_rows(fps, roots).select("root", F.col("least.doc_id").alias("component_id"))
    classes = cut(spread_join(roots, named, "root", ["fp"]).select("fp", "component_id"))
    return small_join(fps, classes, "fp", ["doc_id", "code"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
