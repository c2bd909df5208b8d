import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tablewright.llm import best_fit_packing as P
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "Hello, World! it's we've  don't 12 345 a.b,c;;  déjà VU Ñandú ça œuvre straße",
    "", None, " \n\t ", "á éclair ́x", "x y　z ΑΣ ΟΔΟΣ, İstanbul", "<|endoftext|> a<|startoftext|>b",
    "token=\"abc\" AKIA123 日本語テキスト \U0001f600\U0001f600 ﬁn ǅ !!?? ... 'll 's'", "one\x0btwo\x0cthree\x1cfour five", "IDIOT!! idiot, Idiot. idiot",
]


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(5)
    words = [w for t in TEXTS if t for w in t.split(" ")]
    texts = TEXTS + [" ".join(rng.choices(words, k=50)) for _ in range(40)] + ["é" * 5000 + " " + "ab" * 4000]
    encode = P.Encoder(open(PATH, encoding="utf-8").read())
    for _ in range(2):
        assert [x.tolist() for x in encode(pa.array(texts))] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(rows, docs, tokenizer, capacity=2048):
    sequences, want = {}, []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for i, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((doc_id, i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packs_whole_documents(spark, tokenizer):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ("ne", "tion", "é", "xyz")]
    docs = [(k, " ".join(rng.choices(vocab, k=int(rng.lognormvariate(6, 1.2))))) for k in range(300)]
    docs += list(enumerate(TEXTS, 1000)) + [(None, "a b"), (None, "a b"), (5, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, uid int")
    n = check(P.pack(df, PATH, cell=64).collect(), docs, tokenizer)
    total = sum(len(tokenizer.encode(t or "").ids) + 1 for _, t in docs)
    assert n <= -(-total // 2048) * 1.03 + 3


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_evolve_is_valid_and_no_worse_than_best_fit():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1500) for _ in range(800)]
    plain = len(P._best_fit(sorted(range(800), key=lambda k: -sizes[k]), sizes, 2048))
    first = P.evolve(sizes, 2048, 1, [])
    again = P.evolve(sizes, 2048, 2, [first, P.evolve(sizes, 2048, 3, [])])
    for bins in (first, again):
        assert max(np.bincount(bins, sizes)) <= 2048
    assert max(again) + 1 <= max(first) + 1 <= plain


def test_crossover_beats_the_best_of_the_seeded_fits():
    """Where best fit leaves room, injecting whole bins makes fewer of them, from the same population."""
    for seed in range(3):
        rng = random.Random(seed)
        sizes = [rng.randrange(400, 901) for _ in range(1500)]
        bins = {}
        for n in (0, 6, 18):
            P.CROSSOVERS, kept = n, P.CROSSOVERS
            try:
                out = P.evolve(sizes, 2048, seed, [])
            finally:
                P.CROSSOVERS = kept
            assert np.bincount(out, sizes).max() <= 2048
            bins[n] = max(out) + 1
        assert bins[18] <= bins[6] < bins[0]


def test_many_empty_texts(spark, tokenizer):
    docs = [(k, "" if k % 2 else None) for k in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert check(P.pack(df, PATH).collect(), docs, tokenizer) == 3
