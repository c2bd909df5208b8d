"""Exact search for the k highest inner products, by dual cover trees.

Rows are dealt into blocks of bounded size, and each block is indexed once, queries and data alike. A
cover tree's levels are nets: the centres at level i lie more than ``BASE`` ** i apart, every row lies
within ``BASE`` ** i of one, and centres of a level are centres at all lower ones. They come from
one farthest-first traversal, whose prefixes are such nets; it ends when a centre has about ``leaf``
rows, and each row belongs to the nearest centre.

Each query block meets each data block in one task, where the two trees are descended together. For a
query node with centre q that covers its rows within radius a, and a data node with centre r and
radius b, no product between their rows exceeds

    q.r + a |r| + b |q| + a b.

A pair of nodes is dropped if this is below the worst k-th score of all queries in the query node;
pairs of leaves are multiplied. Pairs with a higher bound go first, so that the k-th scores rise
early. The results of the blocks are merged by query. In many dimensions, without clusters, the
bounds prune little, and what remains is a blocked multiplication.

Products of moderate numbers are whole in doubles. Rows with larger components are blocks of their own:
there the trees work on numbers scaled by a power of two, with the rounding error added to each
bound, and products that may be among the best are worked out in whole numbers of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a block, at most, and in one of data if there are few.
BLOCK, SMALL_BLOCK = 16_384, 2048
#: Rows of a leaf of queries and of data, about, and the ratio of two levels' distances.
QUERY_LEAF, LEAF, BASE = 4, 128, 1.3
#: Whole numbers up to here are exact in doubles.
EXACT = 2.0**53


@dataclass
class Index:
    """A cover tree's nets over some rows: ``home`` is the place of each row's centre in ``centres``, and
    ``parents`` that of a centre's parent, which is within ``BASE`` ** (its level + 1)."""

    centres: np.ndarray
    levels: np.ndarray
    parents: np.ndarray
    home: np.ndarray


@dataclass
class Node:
    """A centre at a level, and the rows below it. The first child has the same centre."""

    rows: np.ndarray
    centre: np.ndarray
    norm: float
    radius: float
    level: float
    children: list[Node] = field(default_factory=list)
    #: Of a query node: the least k-th score of its queries.
    worst: float = -np.inf


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def index(x: np.ndarray, leaf: int = LEAF) -> Index:
    """Nets of the rows of ``x``, until a centre has ``leaf`` rows on average or all rows are centres."""
    centres, levels, far = [0], [math.inf], _far(x, x[0])
    home, parents = np.zeros(len(x), np.int32), [-1]
    # by centre: its distances to the rows
    away = [far.copy()]
    while len(centres) * leaf < len(x) and far.max() > 0:
        k = int(far.argmax())
        level = _level(far[k])
        # the centres of the next level are the first ones, whose gaps are greater
        above = next((n for n, other in enumerate(levels) if other <= level), len(levels))
        parents.append(int(np.argmin([away[n][k] for n in range(above)])))
        centres.append(k)
        levels.append(level)
        away.append(_far(x, x[k]))
        closer = away[-1] < far
        home[closer], far[closer] = len(centres) - 1, away[-1][closer]
    levels[0] = max(levels[1:], default=0) + 1
    return Index(np.array(centres, np.int32), np.array(levels, np.int32), np.array(parents, np.int32), home)


def _level(gap: float) -> int:
    """The highest level whose distance is less than ``gap``."""
    return math.ceil(math.log(gap, BASE)) - 1


def tree(x: np.ndarray, found: Index) -> Node:
    """The tree of nodes over ``found``: one for each centre and level at which it has children."""
    rows: list[list[np.ndarray]] = [[r] for r in _groups(found.home, len(found.centres))]
    top: dict[int, Node] = {}
    below: dict[int, dict[int, list[Node]]] = {}
    # children come after their parents
    for j in range(len(found.centres) - 1, -1, -1):
        c = x[found.centres[j]]
        norm = float(np.sqrt(c @ c)) * (1 + 1e-9)

        def node(level: float, children: list[Node], held: np.ndarray, c: np.ndarray = c, norm: float = norm) -> Node:
            # rounded up, so that the bounds hold
            radius = float(_far(x[held], c).max(initial=0)) * (1 + 1e-9)
            return Node(held, c, norm, radius, level, children)

        made = node(-math.inf, [], rows[j][0])
        for level in sorted(below.get(j, {})):
            children = [made, *below[j][level]]
            made = node(level + 1, children, np.concatenate([n.rows for n in children]))
        top[j] = made
        if j:
            below.setdefault(int(found.parents[j]), {}).setdefault(int(found.levels[j]), []).append(made)
    return top[0]


def _groups(home: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(home, kind="stable")
    return np.split(order, np.searchsorted(home[order], np.arange(1, n)))


class Search:
    """The k best rows of ``data`` for each row of ``queries``.

    Ties go to the smaller ``order``. ``own`` and ``theirs`` number the rows of the two sides; a row
    is no candidate for the query with its number. ``exact`` gives the true products of a query and
    some rows, and a number from below for a true product, where those of ``queries`` and ``data``
    aren't exact.
    """

    def __init__(self, queries: np.ndarray, data: np.ndarray, own: np.ndarray, theirs: np.ndarray, order: np.ndarray, k: int, exact: Exact | None = None) -> None:
        self.q, self.x, self.own, self.theirs, self.order, self.k, self.exact = queries, data, own, theirs, order, k, exact
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.kth = np.full(len(queries), -np.inf)
        self.pairs = 0

    def run(self, queries: Index | None = None, data: Index | None = None) -> list[list[tuple]]:
        """For each query its (minus score, order, row of data), best first."""
        self._meet(tree(self.q, queries or index(self.q, QUERY_LEAF)), tree(self.x, data or index(self.x)))
        return self.best

    @staticmethod
    def _bound(a: Node, b: Node) -> float:
        exact = float(a.centre @ b.centre)
        rest = a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return exact + rest + 1e-9 * (a.norm * b.norm + rest)

    def _meet(self, a: Node, b: Node) -> None:
        if self._bound(a, b) < a.worst:
            return
        if not a.children and not b.children:
            self._multiply(a, b)
        elif not b.children or (a.children and a.radius > b.radius):
            for child in a.children:
                self._meet(child, b)
            a.worst = min(c.worst for c in a.children)
        else:
            for child in sorted(b.children, key=lambda c: -self._bound(a, c)):
                self._meet(a, child)

    def _multiply(self, a: Node, b: Node) -> None:
        self.pairs += len(a.rows) * len(b.rows)
        scores = self.q[a.rows] @ self.x[b.rows].T
        order = self.order[b.rows]
        slack = 0.0 if self.exact is None else 1e-9 * (a.norm + a.radius) * (b.norm + b.radius)
        hit = scores + slack >= self.kth[a.rows][:, None]
        for n in np.flatnonzero(hit.any(axis=1)):
            row = int(a.rows[n])
            at = np.flatnonzero(hit[n])
            at = at[self.theirs[b.rows[at]] != self.own[row]]
            if self.exact is None:
                if len(at) > self.k:
                    at = at[np.lexsort((order[at], -scores[n, at]))[: self.k]]
                found = [(-scores[n, j], order[j], int(b.rows[j])) for j in at]
            else:
                found = [(-s, order[j], int(b.rows[j])) for s, j in zip(self.exact.products(row, b.rows[at]), at, strict=True)]
            self.best[row] = sorted(self.best[row] + found)[: self.k]
            if len(self.best[row]) == self.k:
                worst = -self.best[row][-1][0]
                self.kth[row] = worst if self.exact is None else self.exact.below(worst)
        a.worst = float(self.kth[a.rows].min())


def whole(x: float) -> int:
    """floor(256 x), also where 256 x is no double."""
    return 256 * int(x) if abs(x) >= EXACT else math.floor(256 * x)


@dataclass
class Exact:
    """Products in whole numbers, for vectors that were scaled by 2 ** -shift in all."""

    queries: np.ndarray
    data: np.ndarray
    shift: int
    seen: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    def _whole(self, side: int, row: int) -> list[int]:
        if (side, row) not in self.seen:
            self.seen[side, row] = [whole(v) for v in (self.queries, self.data)[side][row].tolist()]
        return self.seen[side, row]

    def products(self, query: int, rows: np.ndarray) -> list[int]:
        q = self._whole(0, query)
        return [sum(s * t for s, t in zip(q, self._whole(1, int(r)), strict=True)) for r in rows]

    def below(self, score: int) -> float:
        # the scaled score is at most the number of dimensions
        scaled = math.ldexp(float((score << 64) >> self.shift), -64)
        return scaled - 1e-9 * abs(scaled) - 2.0**-60


def scaled(x: np.ndarray, large: bool) -> tuple[np.ndarray, int]:
    """floor(256 x), scaled by 2 ** -shift to at most 1 if ``large``, and shift."""
    if not large:
        return np.floor(256 * x), 0
    shift = int(np.frexp(np.abs(x).max(initial=0))[1]) + 8
    return np.where(np.abs(x) < 2.0**44, np.ldexp(np.floor(256 * np.where(np.abs(x) < 2.0**44, x, 0)), -shift), np.ldexp(x, 8 - shift)), shift


def _indexed(rows: pa.Table, leaf: int, schema: pa.Schema) -> pa.Table:
    """One row for a block: its vectors, and the index of these."""
    rows = rows.sort_by("uid")
    size, large, part = (rows[c][0].as_py() for c in ("size", "large", "part"))
    x = np.array([np.asarray(v.values) for v in rows["v"]], np.float64).reshape(rows.num_rows, size)
    found = index(scaled(x, large)[0], leaf)
    held = [rows["uid"].to_numpy(), rows["place"].to_numpy(), x.ravel(), found.centres, found.levels, found.parents, found.home]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([size, large, part, *held], schema.types, strict=True)], schema=schema)


def _block(held: list[pa.ListScalar], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Index]:
    uid, place, x, *nets = (np.asarray(c.values) for c in held)
    return uid, place, x.reshape(len(uid), size), Index(*nets)


def wide(score: int) -> str | None:
    """For a score that no long holds, a string that sorts like it; None for others."""
    if -(2**63) < score < 2**63 - 1:
        return None
    digits = str(abs(score))
    told = f"{len(digits):06d}{digits}"
    return "1" + told if score > 0 else "0" + told.translate(str.maketrans("0123456789", "9876543210"))


def _met(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            row = {c: batch.column(c)[n] for c in batch.schema.names}
            size, large, asked_large = (row[c].as_py() for c in ("size", "large", "q_large"))
            uid, place, x, data = _block([row[c] for c in HELD], size)
            quid, _, q, queries = _block([row[f"q_{c}"] for c in HELD], size)
            (a, down), (b, further) = scaled(q, asked_large), scaled(x, large)
            exact = Exact(q, x, down + further) if large or asked_large else None
            best = Search(a, b, quid, uid, place, k, exact).run(queries, data)
            out = [(int(quid[i]), int(uid[j]), -int(s)) for i, found in enumerate(best) for s, _, j in found]
            ids, others, scores = zip(*out, strict=True) if out else ((), (), ())
            held = [max(min(v, 2**63 - 1), -(2**63)) for v in scores]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, others, held)), pa.array(map(wide, scores), pa.string())], ["quid", "uid", "score", "wide"])


#: What is held of a block, and its types.
HELD = ["uid", "place", "x", "centres", "levels", "parents", "home"]
_TYPES = dict(zip(HELD, [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())], strict=True))


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, block: int = BLOCK, small: int = SMALL_BLOCK) -> DataFrame:
    """The k best rows of ``vectors`` (vec_id, embedding, ...) for each row that ``queries`` selects.

    Columns: query_id, rank (from 1), vec_id, score: the inner product of floor(256 x). All rows but
    the query's own are candidates; ties go to the smaller vec_id, null last, then to either row of
    those that share it. Other columns of ``vectors`` are ignored.

    Rows whose vector is null or holds a null, NaN or infinite component take no part; all others
    do, however large. Scores are ranked as the whole numbers that they are; one that no long holds is
    told as the long nearest to it. Vectors of different lengths have no product. A row without
    vec_id is no query. Each row of a repeated vec_id is a query, and a candidate for the others.
    Fewer candidates than k give fewer rows; an empty table gives an empty result.
    """
    v = F.col("v")
    ok = v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # repeated vec_ids are told apart by the row's number
    vecs = cut(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.coalesce(ok, F.lit(False))))
    # products of smaller components add up to whole numbers below EXACT
    most = F.sqrt(F.lit(EXACT) / F.greatest(F.size(v), F.lit(1))) / 256 - 1
    large = F.exists("v", lambda x: F.abs(x) > most)
    place = F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1))
    vecs = vecs.withColumns({"uid": F.monotonically_increasing_id(), "size": F.size(v), "large": large, "place": place})
    asked = vecs.where(queries)
    n, m = vecs.count(), asked.count()
    parallel = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, groups = max(-(-n // block), min(parallel, -(-n // small)), 1), max(-(-m // block), 1)

    def indexed(rows: DataFrame, parts: int, leaf: int) -> DataFrame:
        by = ["size", "large", "part"]
        kinds = pa.schema([("size", pa.int32()), ("large", pa.bool_()), ("part", pa.int32()), *_TYPES.items()])
        told = "size int, large boolean, part int, uid array<long>, place array<long>, x array<double>, centres array<int>, levels array<int>, parents array<int>, home array<int>"
        rows = rows.select("size", "large", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int").alias("part"), "uid", "place", "v")
        return cut(rows.groupBy(*by).applyInArrow(lambda t: _indexed(t, leaf, kinds), told))

    data, query = indexed(vecs, blocks, LEAF), indexed(asked, groups, QUERY_LEAF)
    # a copy of each block of queries for each block of data; these have their own keys
    query = query.select("size", F.col("large").alias("q_large"), *[F.col(c).alias(f"q_{c}") for c in HELD])
    query = query.withColumn("large", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("part", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    pairs = data.join(query, ["size", "large", "part"])
    found = pairs.mapInArrow(lambda batches: _met(batches, k), "quid long, uid long, score long, wide string")
    ids = vecs.select("uid", "vec_id")
    best = found.join(ids, "uid")
    order = W.partitionBy("quid").orderBy(F.desc("score"), F.desc_nulls_last("wide"), F.col("vec_id").asc_nulls_last(), "uid")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(ids.select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id")), "quid").select("query_id", "rank", "vec_id", "score")
