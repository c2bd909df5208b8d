import random
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F
from tablewright.llm.line_dedup import WORDS
from tests.llm.test_best_fit_packing import check
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_copies import brute as brute_near


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer
    from tablewright.llm.common import tokenizer_path

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(500)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        words = rng.choices(vocab, k=rng.randrange(30, 200))
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zzork", "quux", "vroxy"]))
        text = " ".join(words) + (f"\n{passage}\nend {k}" if k % 7 == 0 else "")
        rows.append((k, text, "en", f"s{k % 3}" if k % 11 else None, len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[k][1].replace(" ", "  ", 1) + " more", "en", "s0", 1) for k in range(20)]
    rows += [(2000, None, "en", "s1", 0), (2001, "", None, "s1", 0), (None, "odd one out here", "en", "s2", 3), rows[1], rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append(docs.collect())
    pairs = lambda rows: [(r[0], r[1]) for r in rows]
    clean = [r for r in rows if not any(w in (r[1] or "") for w in ("zzork", "quux", "vroxy"))]
    assert Counter(pairs(kept[0])) == Counter(pairs(clean))
    assert Counter(pairs(kept[1])) == Counter((d, n) for d, _, n in brute_lines(pairs(kept[0]), WORDS))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[1])
    # a doc_id can be in several groups, so rows are numbered in its order
    ordered = sorted(pairs(kept[1]), key=lambda r: (r[0] is None, r[0] or 0))
    first = brute_near([(n, t) for n, (_, t) in enumerate(ordered)])
    assert Counter(r.doc_id for r in kept[2]) == Counter(ordered[n][0] for _, n in first)
    assert set(pairs(kept[3])) <= set(pairs(kept[2])) and max(Counter(r.doc_id for r in kept[3]).values()) == 2
    total = sum(len((r.text or "").split()) for r in kept[2])
    assert abs(sum(len(r.text.split()) for r in kept[3]) - 1.5 * total) < 1000
    assert check(kept[4], pairs(kept[3]), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))) >= 1
    assert P.run(spark, str(tmp_path)).count() == len(kept[4])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
