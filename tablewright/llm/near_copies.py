"""Near copies by their word shingles: Jaccard similarity of the sets of ``WORDS``-word shingles.

Candidates come from a tiled exact comparison of SimHashes of 128 bits, links from the shingles. Of
two sets at similarity 0.8 about 19 of the 128 bits differ (standard deviation 4), of unrelated ones
64, so pairs within ``RADIUS`` bits are nearly all that are at 0.8 or above, and few others.

Texts of the same shingles are one node. The tiles give a spanning forest of the pairs within the
radius, never the pairs, and the forest loose groups, which hold all links. A loose group is dealt
into blocks of bounded size, and each pair of blocks is compared in one task: how many shingles any
two nodes share is a product of two matrices of zeros and ones, so every pair is verified exactly,
and what leaves the task is a spanning forest of the links. A group of n near copies thus costs
about n rows and n squared multiplications, however many of its pairs are just below the bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lean, matched, small_join, spread_join, text_code
from .simhash_dedup import CHUNK, least_rows, spanning

WORDS, SIMILARITY = 5, 0.8
#: Differing bits of a candidate, at most: of 128, and of the first 64.
RADIUS, HALF = 32, 20
#: Fingerprints in a tile, about, and rows of a tile compared at once.
TILE, ROWS = 32_768, 8
#: Shingles in a block of a loose group, about, sets in it, and columns of a matrix of shingles.
BLOCK, SETS, COLUMNS = 200_000, 1000, 4096


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, two numbers each, sorted by the first; a text of fewer words is one shingle."""
    terms = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(terms)
    if len(terms) <= words:
        digests = xxhash.xxh3_128_digest(joined) if terms else b""
    else:
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        ends = np.cumsum(length + 1) - 1
        starts = (ends - length)[: len(terms) - words + 1].tolist()
        digest = xxhash.xxh3_128_digest
        digests = b"".join([digest(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return hashes[np.unique(hashes[:, 0], return_index=True)[1]]


def signature(hashes: np.ndarray) -> tuple[int, int, int, int]:
    """What tells a set of shingles from others, the two halves of its SimHash, as signed numbers, and its size."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), axis=1).view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight byte counters in each number
        counts += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    low, high = np.packbits(2 * counts > len(hashes)).view(np.int64).tolist()
    return int(np.uint64(xxhash.xxh64_intdigest(hashes[:, 0].tobytes())).view(np.int64)), low, high, len(hashes)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([signature(shingles(t.as_py())) for t in batch.column(2)], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in found.T)], ["doc_id", "code", "fp", "s1", "s2", "n"])


def near(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of a spanning forest of the pairs within ``RADIUS`` bits between two tiles, each of
    two arrays: the halves of SimHashes."""
    shift = 0 if same else len(a[0])
    label = np.arange(shift + len(b[0]))
    out = []
    for start in range(0, len(a[0]), ROWS):
        at = start if same else 0
        first = np.bitwise_count(a[0][start : start + ROWS, None] ^ b[0][None, at:])
        left, right = np.divmod(np.flatnonzero(first <= HALF), first.shape[1])
        left, right, bits = left + start, right + at, first[left, right]
        keep = (label[left] != label[right + shift]) & (bits + np.bitwise_count(a[1][left] ^ b[1][right]) <= RADIUS)
        left, right = left[keep], right[keep]
        if len(left):
            label, picked = spanning(label, left, right + shift)
            out.append((left[picked], right[picked]))
    return tuple(np.concatenate([x[k] for x in out] or [np.empty(0, np.int64)]) for k in range(2))


def _near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, same = batch.column(0), batch.column(1), batch.column(2)
        for k in range(batch.num_rows):
            x, y = ([np.asarray(tile[k].values.field(n)) for n in range(3)] for tile in (a, b))
            left, right = near(*((v[1].view(np.uint64), v[2].view(np.uint64)) for v in (x, y)), same[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x[0][left]), pa.array(y[0][right])], ["u", "v"])


def near_links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning forest in each pair of tiles of ``nodes`` (fp, s1, s2)."""
    parts = max(1, -(-nodes.count() // tile))
    blocks = cut(nodes.groupBy(F.pmod(F.xxhash64("fp"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("fp", "s1", "s2")).alias("tile")))
    ids = blocks.select(F.col("part").alias("p"))
    pairs = ids.join(ids.select(F.col("p").alias("q")), F.expr("p <= q"))
    return cut(_met(pairs, blocks.withColumnRenamed("part", "p"), ["p"], "tile").mapInArrow(lambda batches: lean(_near(batches)), "u long, v long"))


def _met(pairs: DataFrame, blocks: DataFrame, keys: list[str], held: str) -> DataFrame:
    """(a, b, same): both blocks of each pair; ``keys`` name a block, the last of them is q for the second one."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = keys[-1]
    pairs = pairs.withColumn("same", F.col(last) == F.col("q"))
    left, right = blocks.select(*keys, F.col(held).alias("a")), blocks.select(*keys[:-1], F.col(last).alias("q"), F.col(held).alias("b"))
    return pairs.join(left, keys).join(right, [*keys[:-1], "q"]).select("a", "b", "same").repartition(n)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py())[:, 0].view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]], ["fp", "hashes", "root", "p"])


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each shingle that two rows have, in a matrix of rows and shingles, and the columns' number."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column, count = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True, return_counts=True)[1:]
    shared = count > 1
    keep = shared[column]
    return row[keep], (np.cumsum(shared) - 1)[column[keep]], int(shared.sum())


def alike(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of a spanning forest of the pairs of sets, without repeats, at ``SIMILARITY`` or above."""
    row, column, n = _numbered(a if same else a + b)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(a) if same else len(b)), np.float32)
    for start in range(0, n, COLUMNS):
        p, q = np.searchsorted(column, [start, start + COLUMNS])
        ones = np.zeros((len(a) + (0 if same else len(b)), min(COLUMNS, n - start)), np.float32)
        ones[row[p:q], column[p:q] - start] = 1
        both += ones[: len(a)] @ (ones if same else ones[len(a) :]).T
    size, other = (np.array([len(x) for x in sets], np.float64) for sets in (a, a if same else b))
    # sets are of fewer than 2 ** 24 shingles, so the numbers are whole
    found = both >= SIMILARITY * (size[:, None] + other[None, :] - both) - 1e-6
    left, right = np.nonzero(np.triu(found, 1) if same else found)
    shift = 0 if same else len(a)
    _, picked = spanning(np.arange(len(a) + (0 if same else len(b))), left, right + shift)
    return left[picked], right[picked]


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, same in zip(*batch.columns, strict=True):
            x, y = ((np.asarray(tile.values.field(0)), [np.asarray(s.values) for s in tile.values.field(1)]) for tile in (a, b))
            left, right = alike(x[1], y[1], same.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x[0][left]), pa.array(y[0][right])], ["u", "v"])


def _groups(nodes: DataFrame, docs: DataFrame, tile: int, block: int) -> DataFrame:
    """(fp, root) of ``nodes`` (fp, s1, s2, n: shingles, code): the least node that verified pairs link."""
    loose = components(near_links(nodes, tile)).select(F.col("node").alias("fp"), "root")
    members = cut(nodes.select("fp", "n", "code").join(loose, "fp"))
    # the blocks of a loose group, by its number of shingles and of sets
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block) + F.count(F.lit(1)) / F.lit(SETS)).alias("parts"))
    placed = spread_join(members, parts, "root", ["fp"]).withColumn("p", F.pmod(F.xxhash64("fp"), "parts"))
    placed = cut(placed.select("fp", "code", "root", "p"))
    texts = small_join(docs.select(text_code(F.col("text")).alias("code"), "text", "doc_id"), placed, "code", ["doc_id"]).dropDuplicates(["fp"])
    sets = texts.select("fp", "text", "root", "p").mapInArrow(lambda batches: lean(_sets(batches)), "fp long, hashes array<long>, root long, p long")
    blocks = cut(sets.groupBy("root", "p").agg(F.collect_list(F.struct("fp", "hashes")).alias("block")))
    ids = blocks.select("root", "p")
    pairs = ids.join(ids.withColumnRenamed("p", "q"), "root").where("p <= q")
    links = cut(_met(pairs, blocks, ["root", "p"], "block").mapInArrow(lambda batches: lean(_links(batches)), "u long, v long"))
    member = components(links).select(F.col("node").alias("fp"), "root")
    return cut(nodes.select("fp").join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def first_copies(docs: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), with their columns, that are the first of their group.

    Texts at ``SIMILARITY`` or above are linked, and a group is what links reach. Texts are compared
    by their words, in lower case (ASCII). Blank texts, null ones too, are one group. The first is the
    row with the smallest doc_id, null last; ties go to the smaller hash of the text, and of rows that
    agree in both, one stays. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_code(F.col("text")).alias("code"), "text")
    rows = cut(texts.mapInArrow(lambda batches: lean(_signatures(batches)), f"doc_id {kind}, code long, fp long, s1 long, s2 long, n long"))
    nodes = cut(rows.groupBy("fp").agg(F.min("code").alias("code"), *[F.min(c).alias(c) for c in ("s1", "s2", "n")]))
    roots = _groups(nodes, docs, tile, block)
    stay = cut(least_rows(rows, roots).select("least.doc_id", "least.code"))
    return matched(docs, stay).where("copy = 1").select("row.*")
