"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Full pieces are
sequences of their own. The others are dealt by a hash into cells of about ``cell`` pieces, and
each cell is packed by several islands, each with a population of its own:

* an individual is a list of bins; the first ones come from best-fit over shuffled orders;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that
  then hold a piece twice, and best-fits the displaced pieces, largest first;
* after an epoch, each island's best individual migrates to the next island of its cell, which
  starts its next population from it. After the last epoch the best of a cell's islands stays.

The bins of all cells that aren't nearly full are then dissolved, and their pieces dealt into fewer
cells and packed again, so what cells waste at their edges is gathered. Every step is a table in
the checkpoint folder; a lost executor costs the islands that it was working on.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lean

CAPACITY = 2048
CELL = 8192
ISLANDS = 2
EPOCHS = 2
ROUNDS = 3
#: Individuals of an island, and crossovers in an epoch.
POPULATION, CROSSOVERS = 4, 6
#: A bin with fewer free places than this is well-filled: 1 part in so many.
WELL = 128
#: Words, and pre-tokens, whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Pre-tokens that go to the tokenizer at once.
AT_ONCE = 20_000
#: Bytes of text that are tokenized together.
TOGETHER = 16 << 20

#: Texts of ASCII and the letters of Latin-1: composed as they are, and lower case is one to one.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's pre-tokens in such a text in lower case.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\x0b\x0c\ra-zß-öø-ÿ0-9]+")


class Store:
    """Token ids by string, in arrays; at most ``REMEMBERED`` strings, and then it starts anew."""

    def __init__(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.ids, self.length, self.starts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, keys: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of distinct ``keys``; ``learn`` gives the ids of new ones in a row, and how many each has."""
        at = pc.index_in(keys, value_set=self.keys)
        if at.null_count and len(self.keys) + at.null_count > REMEMBERED:
            self.__init__()  # as new
            at = pc.index_in(keys, value_set=self.keys)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        if at.null_count:
            new = pc.is_null(at)
            added = keys.filter(new)
            ids, length = learn(added.to_pylist())
            places[new.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(added))
            self.keys = pa.concat_arrays([self.keys, added])
            self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, length])
            self.starts = np.cumsum(self.length) - self.length
        return places

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at ``places`` in a row, and where each ends."""
        n = self.length[places]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.starts[places] - ends + n, n) + np.arange(n.sum())], ends


class Encoder:
    """Token ids of texts, equal to the tokenizer's for the whole text.

    Nothing in the tokenizer reaches over white space, so the ids of a text are those of its words,
    and each distinct word of many texts is looked up once. In plain words, which most are, a
    pattern finds the pre-tokens; those that aren't known yet go to the tokenizer all at once, and
    their ids are divided at those that end a word, as each pre-token's last one does.
    """

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [t for t in self.tokenizer.get_vocab() if t not in vocabulary]
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.parts = Store(), Store()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, lengths = [], []
        for at in range(0, len(parts), AT_ONCE):
            some = parts[at : at + AT_ONCE]
            each = self._ids([" ".join(some)])
            length = np.diff(np.flatnonzero(self.ends[each[0]]), prepend=-1)
            if len(length) != len(some):
                each = self._ids(some)
                length = np.array([len(x) for x in each])
            found += each
            lengths.append(length)
        return np.concatenate(found), np.concatenate(lengths)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(words)
        if _PLAIN.fullmatch(joined) and not any(t in joined for t in self.special):
            parts = list(map(_PARTS.findall, joined.lower().split(" ")))
            each = pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
            places = self.parts.places(each.dictionary, self._parts)
            ids, ends = self.parts.gather(places[each.indices.to_numpy()])
            count = np.fromiter(map(len, parts), np.int64, len(parts))
            return ids, np.diff(np.concatenate([[0], ends])[np.cumsum(count)], prepend=0)
        each = [self._words([w])[0] if _PLAIN.fullmatch(w) and not any(t in w for t in self.special) else None for w in words]
        odd = iter(self._ids([w for w, x in zip(words, each, strict=True) if x is None]))
        each = [next(odd) if x is None else x for x in each]
        return np.concatenate(each), np.array([len(x) for x in each])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        codes = split.flatten().dictionary_encode()
        places = self.words.places(codes.dictionary, self._words)
        index, offsets = codes.indices.to_numpy(), np.asarray(split.offsets)
        for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False):
            yield self.words.gather(places[index[a:b]])[0]


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """One for each Python worker."""
    key = zlib.crc32(source.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(source)
    return _encoders[key]


def _pieces(batches: Iterable[pa.RecordBatch], source: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    encode = encoder(source)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // TOGETHER
        for g in np.unique(group):
            (rows,) = np.nonzero(group == g)
            part = batch.slice(int(rows[0]), len(rows))
            out: list[tuple[int, int, int, int, int]] = []
            for k, found in enumerate(encode(part.column(1))):
                ids = found.tobytes() + end
                n = len(ids) // 4
                out += [(k, i, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for i, s in enumerate(range(0, n, capacity))]
            k, *columns = zip(*out, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; ``tokenizer`` is a file's path."""
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    kind, last = docs.schema["doc_id"].dataType.simpleString(), np.array([end], "<u4").tobytes()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(_pieces(batches, source.value, capacity, last)), schema)


# ---------------------------------------------------------------- packing one cell


class _Free:
    """Bins by free places; the bits of ``mask`` tell which counts of free places occur."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, items: list[int], free: int) -> None:
        self.by[free].append(items)
        self.mask |= 1 << free

    def fit(self, item: int, size: int) -> None:
        """Into the bin that it fills best, else a new one."""
        if above := self.mask >> size:
            free = size + (above & -above).bit_length() - 1
            items = self.by[free].pop()
            if not self.by[free]:
                self.mask ^= 1 << free
            items.append(item)
        else:
            free, items = self.capacity, [item]
        self.put(items, free - size)

    def bins(self) -> list[tuple[list[int], int]]:
        return [(items, free) for free, group in enumerate(self.by) for items in group]


Bins = list[tuple[list[int], int]]


def _best_fit(order: Iterable[int], sizes: list[int], capacity: int, start: Bins = ()) -> Bins:
    free = _Free(capacity)
    for items, left in start:
        free.put(list(items), left)
    for k in order:
        free.fit(k, sizes[k])
    return free.bins()


def _fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller and emptier ones rather than even ones."""
    return len(bins), -sum((capacity - free) ** 2 for _, free in bins)


def _cross(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``b`` go into ``a``."""
    held = {k: n for n, (items, _) in enumerate(a) for k in items}
    well = [x for x in b if x[1] <= capacity // WELL]
    rng.shuffle(well)
    worst = {n for n, _ in sorted(enumerate(a), key=lambda x: -x[1][1])[: max(1, len(a) // 20)]}
    given: Bins = []
    taken: set[int] = set()
    gone = set(worst)
    for items, free in well:
        # a bin that the other parent has as well brings nothing new
        source = {held[k] for k in items}
        if len(source) > 1 and not taken.intersection(items):
            given.append((items, free))
            taken.update(items)
            gone |= source
        if len(given) > len(well) // 10:
            break
    displaced = [k for n in gone for k in a[n][0] if k not in taken]
    displaced.sort(key=lambda k: -sizes[k])
    kept = [x for n, x in enumerate(a) if n not in gone]
    return _best_fit(displaced, sizes, capacity, kept + given)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[int]]) -> list[int]:
    """One island's epoch: the bin of each item in its best individual."""
    rng = random.Random(seed)
    population: list[Bins] = []
    for elite in elites:
        groups: dict[int, list[int]] = {}
        for k, n in enumerate(elite):
            groups.setdefault(n, []).append(k)
        population.append([(g, capacity - sum(sizes[k] for k in g)) for g in groups.values()])
    falling = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    if not population:
        population.append(_best_fit(falling, sizes, capacity))
    least = -(-sum(sizes) // capacity)
    while len(population) < POPULATION and min(map(len, population)) > least:
        spread = rng.uniform(0.02, 0.3)
        population.append(_best_fit(sorted(falling, key=lambda k: -sizes[k] * rng.uniform(1 - spread, 1)), sizes, capacity))
    for _ in range(CROSSOVERS):
        population.sort(key=lambda x: _fitness(x, capacity))
        if len(population[0]) <= least:
            break
        a, b = sorted(rng.sample(range(len(population)), 2))
        child = _cross(population[a], population[b], sizes, capacity, rng)
        if _fitness(child, capacity) < _fitness(population[-1], capacity):
            population[-1] = child
    best = min(population, key=lambda x: _fitness(x, capacity))
    out = [0] * len(sizes)
    for n, (items, _) in enumerate(best):
        for k in items:
            out[k] = n
    return out


def _islands(batches: Iterable[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        bins = [evolve(r["sizes"], capacity, hash((r["cell"], r["island"], epoch)), [e for e in (r["own"], r["guest"]) if e]) for r in rows]
        score = [(max(b) + 1) * 2.0**40 - (np.bincount(b, r["sizes"]) ** 2).sum() for b, r in zip(bins, rows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("island"), pa.array(bins, pa.list_(pa.int32())), pa.array(score, pa.float64())], ["cell", "island", "bins", "score"])


def _pack(items: DataFrame, n: int, capacity: int, cell: int, islands: int, epochs: int) -> DataFrame:
    """Pack ``n`` items (uid, size): (uid, cell, bin, size, free of the bin)."""
    cells = max(1, -(-n // cell))
    dealt = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(cells)).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("uid", F.col("size").cast("int").alias("size")))).alias("items"))
    dealt = cut(dealt.select("cell", F.col("items.uid").alias("uids"), F.col("items.size").alias("sizes")))
    spread = min(cells * islands, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("cell", "sizes", F.explode(F.expr(f"sequence(0, {islands - 1})")).alias("island"))
    none = F.lit(None).cast("array<int>")
    state = rows.withColumns({"own": none, "guest": none})
    for epoch in range(epochs):
        state = state.select("cell", "island", "sizes", "own", "guest").repartition(spread, "cell", "island")
        best = cut(state.mapInArrow(lambda batches, epoch=epoch: _islands(batches, capacity, epoch), "cell long, island int, bins array<int>, score double"))
        if epoch < epochs - 1:
            guest = best.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("guest"))
            own = best.select("cell", "island", F.col("bins").alias("own"))
            state = rows.join(own, ["cell", "island"]).join(guest, ["cell", "island"])
    won = best.groupBy("cell").agg(F.min_by("bins", F.struct("score", "island")).alias("bins"))
    packed = dealt.join(won, "cell").select("cell", F.explode(F.arrays_zip("uids", "sizes", "bins")).alias("x"))
    packed = packed.select("cell", F.col("x.uids").alias("uid"), F.col("x.sizes").cast("long").alias("size"), F.col("x.bins").alias("bin"))
    used = packed.groupBy("cell", "bin").agg(F.sum("size").alias("used"))
    return cut(packed.join(used, ["cell", "bin"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text, ...).

    Columns: doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32,
    sequence_id, offset (place in the sequence, without gaps from 0). Other columns of ``docs``
    are ignored, whatever their names.

    A null text counts as empty and gives one piece of one id. Repeated rows are packed each for
    itself. Longer documents are cut, only the last piece is shorter. An empty table gives an
    empty result.
    """
    cutup = cut(pieces(docs, tokenizer, capacity)).withColumn("uid", F.monotonically_increasing_id())
    full = cutup.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cutup.where(F.col("length") < capacity).select("uid", F.col("length").alias("size"))
    settled, n = [], items.count()
    for turn in range(rounds):
        if not n:
            break
        packed = _pack(items, n, capacity, cell, islands, epochs)
        loose = F.col("used") < capacity - capacity // WELL
        last = turn == rounds - 1 or n <= cell
        done = packed if last else packed.where(~loose)
        settled.append(done.withColumn("sequence_id", (F.lit(turn).cast("long") * (1 << 36) + F.col("cell")) * (1 << 20) + F.col("bin")).select("uid", "sequence_id", "size"))
        if last:
            break
        items = packed.where(loose).select("uid", "size")
        n = items.count()
    placed = full
    for part in settled:
        # a sequence has no more pieces than tokens
        before = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
        placed = placed.unionByName(part.select("uid", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset")))
    return cutup.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
