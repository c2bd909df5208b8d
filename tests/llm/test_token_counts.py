import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tablewright.llm import token_counts as T


def greedy(word, tokens):
    n, at = 0, 0
    while at < len(word):
        best = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in tokens), default=0)
        if not best:
            return 1
        at += best
        n += 1
    return n


@given(st.lists(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=400, deadline=None)
def test_automaton_against_greedy(tokens, word):
    word = bytes(97 + x for x in word)
    assert T.Automaton(tokens).count(word) == greedy(word, set(tokens))


def test_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = set(T.vocabulary(path))
    rng = random.Random(1)
    rows = [(k, " ".join("".join(rng.choices("the ration ñé日x", k=9)) for _ in range(30))) for k in range(20)]
    rows += [(50, ""), (51, None), (52, " \n "), (None, "a b"), (None, "a b"), (53, "x" * 30000 + " y")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    want = [(d, len((t or "").encode().split()), sum(greedy(b" " + w, tokens) if len(w) < 1000 else T.Automaton(tokens).count(b" " + w) for w in (t or "").encode().split())) for d, t in rows]
    assert sorted(map(tuple, T.token_counts(df, path).collect()), key=str) == sorted(want, key=str)
    assert T.token_counts(df.limit(0), path).collect() == []
