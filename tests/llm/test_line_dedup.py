import random
import re
import time

import numpy as np
import xxhash
from tablewright.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(rows, words=40):
    """[(doc_id, text, new text)]: a line goes if it is in a run of lines, of as many words, that occurs earlier."""
    code = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    docs = sorted({(d is None, d or 0, code(t), d, t or "") for d, t in rows})
    tokens = [re.findall(rf"[^{SPACE}]+[{SPACE}]*", doc[4]) for doc in docs]
    plain = [[t.strip(SPACE) for t in x] for x in tokens]
    lines = []  # (begin, end) in words
    for x in tokens:
        cuts = [0, *(n + 1 for n, t in enumerate(x) if "\n" in t or n == len(x) - 1 or t.strip(SPACE)[-1] in ".!?")] if x else [0]
        lines.append(list(zip(cuts, cuts[1:])))
    seen, gone = set(), [set() for _ in docs]
    for k in range(len(docs)):
        for n in range(len(lines[k])):
            # the runs from this line on: longer ones than the shortest matter too, up to the longest shortest one back
            new = []
            for m in range(n, len(lines[k])):
                begin, end = lines[k][n][0], lines[k][m][1]
                if end - begin >= words:
                    run = tuple(tuple(plain[k][p:q]) for p, q in lines[k][n : m + 1])
                    if run in seen:
                        gone[k].update(range(begin, end))
                    new.append(run)
                    if lines[k][m][0] - lines[k][n][1] >= words:
                        break
            seen.update(new)
    new = {}
    for k, doc in enumerate(docs):
        x, out = tokens[k], re.match(rf"[{SPACE}]*", doc[4])[0] if 0 not in gone[k] else ""
        for n, t in enumerate(x):
            if n not in gone[k]:
                out += t
            elif n + 1 < len(x) and n + 1 not in gone[k] and "\n" in t:
                begin = next(m for m in range(n, -1, -1) if m == 0 or m - 1 not in gone[k])
                out += "\n" if begin and "\n" not in x[begin - 1] else ""
        new[doc[3:]] = out.rstrip(SPACE) if len(x) - 1 in gone[k] else out
    total = {doc[3:]: len(tokens[k]) for k, doc in enumerate(docs)}
    out, done = [], set()
    for d, t in rows:
        key = (d, t or "")
        again, _ = key in done, done.add(key)
        out.append((d, t, None if t is None else "" if again and total[key] >= words else new[key]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    for words in (6, 9, 1):
        pool = [" ".join(rng.choices(["a", "b", "c", "d", "e.", "f", "g"], k=rng.choice([0, 1, 2, 3, 7, 9]))) for _ in range(14)]
        rows = [(rng.randrange(10**6), rng.choice(["\n", "\n", " ", "\n\n"]).join(rng.choices(pool, k=rng.randrange(1, 12)))) for _ in range(150)]
        rows += [(10, " x  y z\nq r s t"), (11, "x y z\nq\tr s t "), (12, ""), (13, None), (None, "x y z\nq r s t"), (None, "x y z\nq r s t"), (14, "a b\n" * 40), (15, "a b\n" * 300), (16, " \n "), (17, "é ß. Ü! é ß. Ü! é ß. Ü! é ß")]
        rows += [rows[3], rows[3], (13, None)]
        df = spark.createDataFrame([(d, t, "n", 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, `row` string, code int, runs int, id int, copy int").repartition(5)
        got = L.dedup_lines(df, words).collect()
        assert sorted(((r.row.doc_id, r.row.text) for r in got), key=str) == sorted(((d, n) for d, _, n in brute(rows, words)), key=str)
        assert all(r.row.code == 1 and r.row.runs == 2 and r.row.row == "n" for r in got)
        for r in got:
            assert r.n_words - r.n_removed == len((r.row.text or "").split())


def test_keeps_common_short_lines_and_first_copies(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(k, f"Shared header line\nown text number {k} goes on\n{passage if k in (3, 7, 9) else 'x'}\ntail {k}") for k in range(12)]
    got = {r.row.doc_id: r.row.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert got[k] == (text if k not in (7, 9) else text.replace(passage + "\n", ""))


def test_passage_within_a_line(spark):
    """It has no line feed before or after it; its first sentence shares a line with other words."""
    passage = [" ".join(f"p{n}x{k}" for k in range(9)) + "." for n in range(6)]
    rows = [(k, f"Own words come{k} {' '.join(passage)} after{k} it more {k} goes\non and{k} on.") for k in range(3)]
    got = {r.row.doc_id: r.row.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if not k else t.replace(" ".join(passage[1:]) + " ", "") for k, t in rows}
    few = [(k, t.replace("p3x3 ", f"q{k} ")) for k, t in rows]  # no 40 words in whole lines
    assert {r.row.doc_id: r.row.text for r in L.dedup_lines(spark.createDataFrame(few, "doc_id long, text string")).collect()} == dict(few)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_end_of_a_passage_whose_beginning_came_earlier(spark):
    long, tail = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(10))
    docs = spark.createDataFrame([(1, f"{long}\nfirst goes on"), (2, f"{long}\n{tail}\nsecond goes on"), (3, f"{long}\n{tail}\nthird goes on")], "doc_id long, text string")
    got = {r.row.doc_id: r.row.text for r in L.dedup_lines(docs).collect()}
    assert got == {1: f"{long}\nfirst goes on", 2: f"{tail}\nsecond goes on", 3: "third goes on"}


def test_selects_minima_of_windows():
    """Each window has a selected line, its least, and there are far fewer of these than windows."""
    rng = np.random.default_rng(3)
    sizes = [rng.integers(1, 15, n).astype(np.int32) for n in (0, 1, 3, 2000, 0, 3000, 2)]
    hashes = [rng.integers(-(2**63), 2**63 - 1, len(x)) for x in sizes]
    texts, want, n_windows = L.Texts(hashes, sizes), set(), 0
    for first, h, s in zip(texts.first.tolist(), hashes, sizes):
        for a in range(len(s)):
            b = next((b for b in range(a + 1, len(s) + 1) if s[a:b].sum() >= 25), None)
            if b:
                n_windows += 1
                want.add(first + a + int(h[a:b].argmin()))
    assert set(texts.selected(25).tolist()) == want and len(want) < 0.5 * n_windows
    assert n_windows == len(texts.forth(25)[0]) < len(texts.windows(25)[0])


def test_a_long_text_of_equal_lines_takes_linear_time(spark):
    df = spark.createDataFrame([(1, "same old line here\n" * 100_000), (2, "own words " * 60_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.row.doc_id: r.row.text for r in L.dedup_lines(df).collect()}
    # the first window of 25 words, and of 50, are seven and thirteen lines; from line two on, all has occurred
    assert got[1] == "same old line here" and got[2] == "own words " * 60_000
    assert time.perf_counter() - began < 60


def test_a_line_of_all_texts_is_spread(spark):
    rows = [(k, f"The one line that every text has of its own accord and which is no passage by itself.\nown {k} " + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(3000)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    assert got.count() == 0
