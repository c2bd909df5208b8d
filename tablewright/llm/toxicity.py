"""Toxicity by a cumulative-link ordinal regression on sparse text features.

The model has grades 0 to K. With eta the weighted sum of a text's features, the probability that
its grade is at least k is sigmoid(eta - threshold_k): all thresholds share the weights, and they
rise. The expected severity is the sum of these probabilities.

Grades are those of the labels: ``severity`` from 0 to K if there is such a column, otherwise ``toxic``, 0
and 1, with a single threshold, where the expected severity is the probability of being toxic.

Features are the words of a text (runs of letters, in lower case) and the beginnings of words, so that
inflected and compound forms count; a feature's value is the logarithm of 1 plus its count. Those that
toxic texts of the sample use more take part, all of them or the best by likelihood ratio. The weaker a
feature's ratio, the stronger its ridge penalty, so that those which go with the label by chance
count little beside the others.

The model is fitted on a bounded sample of labelled documents, drawn by a hash of doc_id, one text for
each. The texts stay on the executors; the driver gets the features and the sample's counts of these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, text_code

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 10_000
#: Features that take part, at most; None is all that the sample has.
FEATURES = 2000
#: Letters of the beginnings of words that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: Likelihood ratio (twice the logarithm) below which the penalty rises with the third power.
WEAK = 10.0
#: Words that a worker remembers, and bytes of text that are read together.
REMEMBERED, TOGETHER = 200_000, 4 << 20


def of_word(word: str, prefixes: Sequence[int] = PREFIXES) -> list[str]:
    """A word's features."""
    return ["=" + word, *["^" + word[:n] for n in prefixes if n <= len(word)]]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, place of the word in the list, list of distinct words) of each word in ``texts``; null is empty."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    parts = pc.split_pattern_regex(low, r"\PL+")
    codes = parts.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))
    return row, codes.indices.to_numpy(), codes.dictionary.to_pylist()


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in parts of about ``TOGETHER`` bytes, and where each begins."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.flatnonzero(np.diff(size // TOGETHER, prepend=-1)) if len(size) else []
    for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    prefixes: tuple[int, ...] = PREFIXES
    #: Weights' places by feature, and by word as far as seen.
    places: dict[str, int] = field(default_factory=dict)
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.places = {f: k for k, f in enumerate(self.features)}

    def __reduce__(self) -> tuple:
        return Model, (self.features, self.weights, self.thresholds, self.prefixes)

    def _places(self, word: str) -> tuple[int, ...]:
        if (at := self.seen.get(word)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            at = self.seen[word] = tuple(self.places[f] for f in of_word(word, self.prefixes) if f in self.places) if word else ()
        return at

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count) of the features in ``texts``, by row and feature."""
        row, code, distinct = words(texts)
        at = [self._places(w) for w in distinct]
        many = np.fromiter(map(len, at), np.int64, len(at))
        some = np.flatnonzero(many[code])  # the words that have features, few
        row, code = row[some], code[some]
        ends, flat = np.cumsum(many), np.fromiter((k for x in at for k in x), np.int64)
        n = many[code]
        which = np.repeat((ends - many)[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys, count = np.unique(np.repeat(row, n) * max(len(self.features), 1) + flat[which], return_counts=True)
        return (*np.divmod(keys, max(len(self.features), 1)), count)

    def at_least(self, texts: pa.Array) -> np.ndarray:
        """For each text the probabilities that its grade is at least 1, 2, ..."""
        eta = np.zeros(len(texts))
        for start, part in chunks(texts):
            row, feature, count = self.counts(part)
            eta[start : start + len(part)] = np.bincount(row, self.weights[feature] * np.log1p(count), len(part))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -50, 50)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, count: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 0.3, steps: int = 400, rate: float = 0.1, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds, by Adam on the penalised likelihood.

    The rows' ``grades`` go with entries of a sparse matrix: ``count`` times feature ``col`` in ``row``. ``scale`` multiplies the features' values while fitting, which divides ``ridge`` by its square.
    """
    scale = np.ones(n_features) if scale is None else scale
    top = int(grades.max(initial=0))
    if not top or grades.min() > 0:
        return np.zeros(n_features), np.full(max(top, 1), 50.0 if not top else -50.0)
    val = np.log1p(count.astype(float)) * scale[col]
    # thresholds: the first, then the logarithms of the steps between them
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(np.clip(p[n_features + 1 :], -10, 5))
        theta = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(row, val * w[col], len(grades)) if len(row) else np.zeros(len(grades))
        up = np.where(grades > 0, sigmoid(eta - theta[np.maximum(grades, 1) - 1]), 1.0)
        down = np.where(grades < top, sigmoid(eta - theta[np.minimum(grades, top - 1)]), 0.0)
        d_up, d_down = up * (1 - up), down * (1 - down)
        share = np.maximum(up - down, 1e-9)
        g_eta = -(d_up - d_down) / share
        g_theta = np.bincount(np.maximum(grades, 1) - 1, np.where(grades > 0, d_up / share, 0), top) - np.bincount(np.minimum(grades, top - 1), np.where(grades < top, d_down / share, 0), top)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, val * g_eta[row], n_features) + ridge * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(p[n_features + 1 :], -10, 5))
    return p[:n_features] * scale, p[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def _frequencies(batches: Iterable[pa.RecordBatch], prefixes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """How many texts with a grade above 0, and with grade 0, have each feature."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for start, part in chunks(batch.column(0)):
            row, code, distinct = words(part)
            pairs = np.unique(row.astype(np.int64) << 32 | code)
            of = [of_word(w, prefixes) if w else [] for w in distinct]
            for n, codes in enumerate(np.split(pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(1, len(part))))):
                counts[batch.column(1)[start + n].as_py() > 0].update({f for c in codes.tolist() for f in of[c]})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (counts[1], counts[0]))], ["feature", "bad", "good"])


def _counts(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[list[int], list[int]]] = []
        for _, part in chunks(batch.column(0)):
            row, feature, count = model.counts(part)
            cuts = np.searchsorted(row, np.arange(1, len(part)))
            found += [(k.tolist(), n.tolist()) for k, n in zip(np.split(feature, cuts), np.split(count, cuts), strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)), batch.column(1)], ["k", "n", "grade"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int | None = FEATURES, prefixes: Sequence[int] = PREFIXES) -> Model:
    """A model from ``labels`` (doc_id, toxic, or severity: grades from 0) of ``docs`` (doc_id, text).

    At most ``sample`` labelled ids take part, and of each id one text, the one with the least hash. Of
    repeated labels the highest counts. ``features`` is the most that the model has, None for all.

    Rows without a doc_id or label, and documents without a label, take no part. Without any
    labelled document, or with one class only, the model gives all texts that class.
    """
    prefixes = tuple(prefixes)
    label = "severity" if "severity" in labels.columns else "toxic"
    known = labels.select("doc_id", F.col(label).cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.max("grade").alias("grade"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # sample rows at most
    one = F.min(F.struct(text_code(F.col("text")).alias("code"), "text")).alias("one")
    texts = cut(texts.groupBy("doc_id", "grade").agg(one).select("one.text", F.greatest("grade", F.lit(0)).alias("grade")))
    sizes = texts.agg(F.count_if(F.col("grade") > 0), F.count(F.lit(1))).first()
    bad, good = sizes[0], sizes[1] - sizes[0]
    rows = texts.mapInArrow(lambda batches: _frequencies(batches, prefixes), "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    n1, n0 = F.col("bad"), F.col("good")
    share = (n1 + n0) / F.lit(float(max(bad + good, 1)))
    ratio = 2 * (part(n1, share * bad) + part(n0, share * good) + part(bad - n1, (1 - share) * bad) + part(good - n0, (1 - share) * good))
    rows = rows.where(n1 * good > n0 * bad).select("feature", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature")
    best = (rows if features is None else rows.limit(features)).collect()  # no more than the sample's words and prefixes
    names, ratios = [r.feature for r in best], np.array([r.ratio for r in best], float)
    blank = Model(names, np.zeros(len(names)), np.zeros(1), prefixes)
    found = texts.mapInArrow(lambda batches: _counts(batches, blank), "k array<int>, n array<int>, grade int").collect()  # sample rows
    row = np.repeat(np.arange(len(found)), [len(r.k) for r in found])
    col, count = (np.array([x for r in found for x in r[c]], int) for c in ("k", "n"))
    weights, thresholds = fit_ordinal(row, col, count, np.array([r.grade for r in found], int), len(names), scale=np.clip(ratios / WEAK, 0, 1) ** 1.5)
    return Model(names, weights, thresholds, prefixes)


def _scores(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at_least = model.at_least(batch.column(batch.num_columns - 1))
        grade = (at_least > 0.5).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at_least.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(grade > 0)], [*batch.schema.names[:-1], "severity", "grade", "toxic"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, grade, toxic) for each row of ``docs`` (doc_id, text, ...), in one pass over whole texts.

    ``severity`` is the expected grade, ``grade`` the highest one that is more likely reached than
    not, ``toxic`` whether that is above 0. A null or blank text has no features. Rows without
    doc_id and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(_scores(batches, shared.value)), f"doc_id {kind}, severity double, grade int, toxic boolean")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't find toxic, with their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.at_least(batch.column(at))[:, 0] <= 0.5))

    return docs.mapInArrow(lambda batches: lean(keep(batches)), docs.schema)
