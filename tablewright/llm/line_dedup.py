"""Removing passages that repeat, by winnowing over hashes of lines.

A line of a text that holds several sentences is taken as several lines, so that a passage put
into the middle of a paragraph still has lines of its own. Blank lines don't count. The method:

* A window is the shortest run of lines from a given one on that holds ``words`` words. Of each window
  the line with the least hash is selected, the last of them if several have it. So a run of lines
  with as many words has a selected line wherever it occurs, and neighbouring windows mostly select
  the same one: a text has far fewer selected lines than windows.
* Selected positions meet by their line's hash. Those that are alone are told back to their texts,
  and text around them is never looked at again.
* From the others, matches are extended both ways as far as windows go that hold them: from each line
  on, and up to each line. Windows with the same hash meet, and the first place of each, in the order
  of documents and lines, is told back.
* All windows at other places are later repeats. Those that overlap or touch are one run, which is
  deleted.

So a line is deleted if, and only if, it lies in a run of whole lines with at least ``words`` words
that occurs earlier, whichever document had its beginning first.

Nothing is joined on a hash, so no hash that a third of the texts share is a hot key: hashes are
grouped, which combines before the shuffle, and what is alone or first goes back by document. Tables
between the steps are rows of numbers; texts are shuffled once, when the runs are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, id_columns, lean, text_code

#: Words in whole lines of the shortest run that is deleted. A passage of 50 words that begins and ends
#: within a sentence has about as many in whole ones.
WORDS = 40

#: What tells a text from others, in the order of documents.
KEY = ["no_id", "id", "code"]
_SPACES = bytes.maketrans(b"\t\x0b\f\r", b"    ")


def lines_of(text: str | None) -> list[list[bytes]]:
    """The words of each line that has any: what line feeds divide, and white space after . ! or ?"""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
    data = data.replace(b". ", b".\n").replace(b"! ", b"!\n").replace(b"? ", b"?\n")
    return [words for part in data.split(b"\n") if (words := part.split())]


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, join = xxhash.xxh64_intdigest, b" ".join
    for batch in batches:
        hashes, sizes, total = [], [], []
        for text in batch.column(3):
            lines = lines_of(text.as_py())
            hashes.append(np.fromiter(map(whole, map(join, lines)), np.uint64, len(lines)).tobytes())
            sizes.append(np.fromiter(map(len, lines), np.int32, len(lines)).tobytes())
            total.append(sum(map(len, lines)))
        held = [*(pa.array(x, pa.binary()) for x in (hashes, sizes)), pa.array(total, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *held], [*KEY, "hashes", "sizes", "total"])


class Texts:
    """The lines of several texts in a row. ``row`` is each line's text, ``first`` each text's first line."""

    def __init__(self, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in hashes], np.int64)
        self.first, self.row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        self.hashes, self.sizes = np.concatenate([*hashes, np.empty(0, np.int64)]), np.concatenate([*sizes, np.empty(0, np.int32)])
        self.end = np.cumsum(self.sizes, dtype=np.int64)
        self.begin = self.end - self.sizes

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Texts:
        """From the columns hashes and sizes."""
        return cls(*([np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)] for c, kind in (("hashes", np.int64), ("sizes", np.int32))))

    def forth(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) line of the shortest run from each line on with ``words`` words."""
        lines = np.arange(len(self.row))
        last = np.searchsorted(self.end, self.begin + words)
        ok = last < len(lines)
        ok[ok] = self.row[last[ok]] == self.row[ok]
        return lines[ok], last[ok]

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Those and the shortest runs up to each line, without repeats, in order."""
        lines = np.arange(len(self.row))
        start = np.searchsorted(self.begin, self.end - words, "right") - 1
        ok = start >= 0
        ok[ok] = self.row[start[ok]] == self.row[ok]
        first, last = (np.concatenate(x) for x in zip(self.forth(words), (start[ok], lines[ok]), strict=True))
        # each line has a word, so a window has no more lines than ``words``
        keys = np.unique(first * (words + 1) + last - first)
        first, more = np.divmod(keys, words + 1)
        return first, first + more

    def selected(self, words: int) -> np.ndarray:
        """Lines with the least hash in a shortest run from a line on, the last one of equals."""
        first, last = self.forth(words)
        best, at, some = first.copy(), first.copy(), np.arange(len(first))
        while True:
            at = at + 1
            inside = at <= last[some]
            some, at = some[inside], at[inside]
            if not len(some):
                return np.unique(best)
            less = self.hashes[at] <= self.hashes[best[some]]
            best[some[less]] = at[less]

    def around(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) lines of the windows that hold a line in ``at``."""
        marked = np.zeros(len(self.row) + 1, np.int64)
        marked[at + 1] = 1
        marked = np.cumsum(marked)
        first, last = self.windows(words)
        near = marked[last + 1] > marked[first]
        return first[near], last[near]

    def told(self, lists: pa.Array) -> np.ndarray:
        """A list of numbers for each text, line numbers in it in their upper 32 bits, as such of all lines."""
        lists = lists.fill_null([])
        flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets))
        return flat + (np.repeat(self.first, n) << 32)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.astype(np.int64)) for c in columns]


def _selected(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts.of(batch)
        at = texts.selected(words)
        row = texts.row[at]
        yield pa.RecordBatch.from_arrays(_longs(texts.hashes[at], batch.column("place").to_numpy()[row], at - texts.first[row] << 32), ["low", "place", "at"])


def _split(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """``values`` by their row, null for rows without any."""
    offsets = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)), mask=pa.array(np.diff(offsets) == 0))


def _shared(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The texts that have selected lines besides those that are alone, with these."""
    for batch in batches:
        texts = Texts.of(batch)
        at = np.setdiff1d(texts.selected(words), texts.told(batch.column("ats")) >> 32, assume_unique=True)
        row = texts.row[at]
        shared = _split(at - texts.first[row] << 32, row, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "hashes", "sizes")), shared], ["place", "hashes", "sizes", "at"]).filter(shared.is_valid())


def _around(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        texts = Texts.of(batch)
        first, last = texts.around(texts.told(batch.column("at")) >> 32, words)
        data, row = memoryview(texts.hashes.tobytes()), texts.row[first]
        whole = np.fromiter((digest(data[p:q], 1) for p, q in zip((8 * first).tolist(), (8 * last + 8).tolist(), strict=True)), np.uint64, len(first))
        start = first - texts.first[row]
        yield pa.RecordBatch.from_arrays(_longs(whole.view(np.int64), batch.column("place").to_numpy()[row], (start << 32) + last - first), ["whole", "place", "span"])


def _repeated(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Runs of words under windows that aren't told to be the first of their kind."""
    for batch in batches:
        texts = Texts.of(batch)
        first, last = texts.around(texts.told(batch.column("at")) >> 32, words)
        later = ~np.isin((first << 32) + last - first, texts.told(batch.column("spans")))
        first, last = first[later], last[later]
        # windows that touch or overlap, of one text, are one run
        row, reach = texts.row[first], np.maximum.accumulate(last)
        new = np.flatnonzero(np.concatenate([[True], (first[1:] > reach[:-1] + 1) | (row[1:] != row[:-1])])) if len(first) else np.empty(0, np.int64)
        row, zero = row[new], texts.begin[texts.first[row[new]]]
        a, b = texts.begin[first[new]] - zero, texts.end[reach[np.append(new[1:] - 1, len(first) - 1)] if len(new) else new] - zero
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(_longs(a, b), ["a", "b"]))
        yield pa.RecordBatch.from_arrays([batch.column("place"), runs], ["place", "runs"]).filter(pa.array(np.diff(offsets) > 0))


def _keys(doc_id: Column, text: Column, docs: DataFrame) -> list[Column]:
    no_id, known = id_columns(doc_id, docs.schema["doc_id"].dataType)
    return [no_id.alias("no_id"), known.alias("id"), text_code(text).alias("code")]


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(no_id, id, code, total, runs) of each distinct pair of doc_id and text: the number of words, and the
    [a, b) of those to delete, in order and without overlap, null if none. The first three are as in ``KEY``."""
    texts = docs.select(*_keys(F.col("doc_id"), F.col("text"), docs), "text")
    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in KEY)
    lines = texts.mapInArrow(lambda batches: lean(_lines(batches)), f"{types}, hashes binary, sizes binary, total long")
    lines = lines.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("hashes", "sizes", "total")])
    # numbered in the order of documents: the ids rise with the sorted partitions
    lines = cut(lines.orderBy(*KEY)).withColumn("place", F.monotonically_increasing_id())
    each = "place long, hashes binary, sizes binary"

    def told(found: DataFrame, key: str, what: str, where: str) -> DataFrame:
        """By place: ``what`` of the first rows of those keys for which ``where`` holds."""
        first = found.groupBy(key).agg(F.min(F.struct("place", what)).alias("first"), F.count(F.lit(1)).alias("n")).where(where)
        return first.select("first.*").groupBy("place").agg(F.collect_list(what).alias(f"{what}s"))

    prints = lines.select("place", "hashes", "sizes").mapInArrow(lambda batches: lean(_selected(batches, words)), "low long, place long, at long")
    held = lines.select("place", "hashes", "sizes").join(told(prints, "low", "at", "n = 1"), "place", "left")
    held = cut(held.mapInArrow(lambda batches: lean(_shared(batches, words)), f"{each}, at array<long>"))
    found = held.mapInArrow(lambda batches: lean(_around(batches, words)), "whole long, place long, span long")
    # windows that occur once are their own first place
    later = held.join(told(found, "whole", "span", "n > 0"), "place", "left")
    runs = cut(later.mapInArrow(lambda batches: lean(_repeated(batches, words)), "place long, runs array<struct<a:long,b:long>>"))
    return lines.select("place", *KEY, "total").join(runs, "place", "left").select(*KEY, "total", "runs")


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated runs taken out of text: a struct ``row`` of all its
    columns, and ``n_words`` and ``n_removed``.

    The order of documents is by doc_id, null last, then by a hash of the text. Of rows that agree
    in doc_id and text, one is treated as above; the others repeat it as a whole and lose all their
    words if they have at least ``words``. Runs within one document count as well.

    Words are what ASCII white space divides. With a run goes the white space after it, but a line
    feed there stays unless one is before the run; a text that loses its end ends in no white space.
    A null text has no words and stays null. A document that loses all words keeps its row, with an
    empty text. An empty table gives an empty result.
    """
    names = [f"_{c}" for c in KEY]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", *[c.alias(n) for c, n in zip(_keys(F.col("row.doc_id"), F.col("row.text"), docs), names, strict=True)])
    runs = repeated_runs(docs, words).withColumnsRenamed(dict(zip(KEY, names, strict=True)))
    copy = F.row_number().over(W.partitionBy(*names).orderBy(F.lit(0)))
    rows = rows.join(runs, names).withColumn("copy", copy).withColumnRenamed("total", "n_words")
    text, space = F.col("row.text"), r"[ \t\n\x0B\f\r]"
    # each word with the white space after it
    tokens = F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*"), F.lit(0))
    last = F.col("n_words") - 1

    def kept(t: Column, i: Column) -> Column:
        run = F.get(F.filter("runs", lambda r: (i >= r["a"]) & (i < r["b"])), F.lit(0))
        feed = (i == run["b"] - 1) & (i < last) & (run["a"] > 0) & t.contains("\n")
        return F.when(run.isNull(), t).when(feed & ~F.get(tokens, (run["a"] - 1).cast("int")).contains("\n"), F.lit("\n")).otherwise(F.lit(""))

    lead = F.when(F.exists("runs", lambda r: r["a"] == 0), "").otherwise(F.regexp_extract(text, f"^{space}*", 0))
    left = F.concat(lead, F.array_join(F.transform(tokens, kept), ""))
    left = F.when(F.exists("runs", lambda r: r["b"] > last), F.regexp_replace(left, f"{space}+$", "")).otherwise(left)
    further = (F.col("copy") > 1) & (F.col("n_words") >= words)
    out = F.when(further, F.lit("")).when(F.col("runs").isNotNull(), left).otherwise(text)
    lost = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    removed = F.when(further, F.col("n_words")).otherwise(F.coalesce(lost, F.lit(0).cast("long")))
    return rows.select(F.col("row").withField("text", out).alias("row"), "n_words", removed.alias("n_removed"))
