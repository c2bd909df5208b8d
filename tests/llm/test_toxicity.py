import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from tablewright.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.2
        words = rng.choices(vocab, k=rng.randrange(10, 200))
        for _ in range(rng.randrange(1, 9) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Zzork!", "QUUX,", "vrox" + rng.choice("abcdef") * rng.randrange(1, 4)]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 1)
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, toxic string")
    model = T.train(docs, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int"))
    assert any(f == "^vrox" for f in model.features) and len(model.thresholds) == 1
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(got[k], bad) for k, bad in labels if k % 2 == 0]
    assert sum(r.toxic == bool(bad) for r, bad in held) / len(held) > 0.98
    assert all(0 <= r.severity <= 1 and (r.grade > 0) == r.toxic for r, _ in held)
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.toxic}


def test_ordinal_recovers_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (3000, 3))
    eta = np.log1p(x) @ [2.0, 1.0, 0.0]
    grades = (eta[:, None] + rng.logistic(size=(3000, 1)) > [1.0, 2.5, 4.0]).sum(axis=1)
    row, col = np.nonzero(x)
    w, theta = T.fit_ordinal(row, col, x[row, col], grades, 3, steps=800)
    assert np.allclose(w, [2, 1, 0], atol=0.25) and np.allclose(theta, [1, 2.5, 4], atol=0.3)


def test_severity_of_graded_labels(spark):
    """Grades 0 to 3 that are drawn from a strength of their own, not from the features; held out documents."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(400)]
    mild, harsh = ["meanish", "sillyoaf", "grumpo"], ["vilefoe", "hatemonk"]
    rows, labels = [], []
    for k in range(2400):
        grade = rng.choices([0, 1, 2, 3], [6, 2, 2, 2])[0]
        words = rng.choices(vocab, k=rng.randrange(20, 200))
        # a text of a grade mostly has the words of that grade, and sometimes those of a neighbour
        told = max(0, min(3, grade + rng.choices([-1, 0, 1], [1, 10, 1])[0]))
        words += rng.choices(mild, k=told if told < 3 else 1) + (rng.choices(harsh, k=told - 1) if told > 1 else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, severity int"))
    assert len(model.thresholds) == 3 and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(got[k], g) for k, g in labels if k % 2 == 0]
    severity, grade, true = (np.array(x, float) for x in ([r.severity for r, _ in held], [r.grade for r, _ in held], [g for _, g in held]))
    assert np.corrcoef(severity, true)[0, 1] > 0.85 and np.abs(severity - true).mean() < 0.4 and np.abs(grade - true).mean() < 0.35
    assert np.abs(severity - true).mean() < 0.5 * np.abs(np.median(true) - true).mean()


def test_scores_against_brute_force(spark):
    """Severity by the formula, with features looked up one by one in every text."""
    rows, labels = corpus(300, 5)
    rows += [(1000, "Zzork! zzorking ZZÖRK\u0130 _zzork_9zzork naïve²x"), (1001, "x " * 50000 + "quux"), (1002, None), (1003, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), features=None)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(model.features) > T.FEATURES / 10 and len(got) == len(rows)
    weight = dict(zip(model.features, model.weights.tolist()))
    for k, text in rows:
        eta, counts = 0.0, {}
        simple = "".join(c.lower() if len(c.lower()) == 1 else "i" for c in text or "")
        word = ""
        for c in simple + " ":
            if unicodedata.category(c)[0] == "L":
                word += c
                continue
            for f in {"=" + word, *("^" + word[:n] for n in range(3, 8) if len(word) >= n)} if word else ():
                counts[f] = counts.get(f, 0) + 1
            word = ""
        eta = sum(weight[f] * math.log1p(n) for f, n in counts.items() if f in weight)
        want = [1 / (1 + math.exp(t - eta)) for t in model.thresholds]
        assert math.isclose(got[k].severity, sum(want), rel_tol=1e-9, abs_tol=1e-12) and got[k].grade == sum(p > 0.5 for p in want)


def test_sample_bounds_the_rows(spark):
    """Repeated doc_ids don't make the driver's share larger."""
    docs = spark.createDataFrame([(k % 20, f"word{k} zzork" if k % 2 else f"word{k}") for k in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3, "doc_id long, toxic int")
    seen, fit = [], T.fit_ordinal
    T.fit_ordinal = lambda row, col, count, grades, *a, **b: (seen.append(len(grades)), fit(row, col, count, grades, *a, **b))[1]
    try:
        model = T.train(docs, labels, sample=7)
        every = T.train(docs, labels)
    finally:
        T.fit_ordinal = fit
    assert seen == [7, 20]
    assert all(r.toxic == (r.doc_id % 2 == 1) for r in T.score(docs, every).collect()) and T.score(docs, model).count() == 5000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "bad"), (2, ""), (2, ""), (3, "x " * 50000)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(docs, empty)
    assert sorted(str((r.doc_id, r.toxic)) for r in T.score(docs, model).collect()) == sorted(str((d, False)) for d in (1, None, 2, 2, 3))
    assert T.score(docs.limit(0), model).collect() == [] and T.clean(docs.limit(0), model).collect() == []
    one = T.train(docs, spark.createDataFrame([(1, 0), (None, 1), (9, 1), (2, None)], "doc_id long, toxic int"))
    assert not any(r.toxic for r in T.score(docs, one).collect())


@pytest.mark.parametrize("size, training, other", [("sf0.001", 1.0, 0.3), ("sf0.01", 0.9, 0.7)])
def test_few_labels_still_find_toxic_texts(spark, size, training, other):
    read = lambda size, name: spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")
    model = T.train(read(size, "documents"), read(size, "labels"))
    for tables, least in ((size, training), ("sf0.1", other)):
        rows = T.score(read(tables, "documents"), model).join(read(tables, "labels").select("doc_id", F.col("toxic").alias("bad")), "doc_id").collect()
        bad, clean = ([r.toxic for r in rows if r.bad == b] for b in (1, 0))
        assert sum(bad) >= least * len(bad) and sum(clean) <= 0.01 * len(clean)
