"""Token counts by greedy longest match, with a linear-time automaton.

The automaton is a trie of the vocabulary whose nodes have failure links. A node's link leads to
the node of what is left after the longest tokens have been taken off the node's string, and the
node knows how many tokens that takes. So one pass over a word's bytes gives its number of tokens,
without going back and without building a token.

A word is a run of other characters than ASCII white space, and is matched with one space before
it: tokens that begin with a space are the ones that may start a word, the others go on with it.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Words whose counts a worker remembers, and their bytes at most.
REMEMBERED, SHORT = 400_000, 64


class Automaton:
    """``count(word)``: tokens that greedy longest match takes for ``word``; 1 if it can't match."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        self.child: dict[int, int] = {}
        child, ends, below = self.child, [False], [[]]
        for token in tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in child:
                    child[key] = len(ends)
                    below[node].append(byte)
                    ends.append(False)
                    below.append([])
                node = child[key]
            ends[node] = bool(token)
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        fail, pops = self.fail, self.pops
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            for byte in below[node]:
                to = child[node << 8 | byte]
                waiting.append(to)
                if ends[to]:
                    fail[to], pops[to] = 0, 1
                    continue
                at, taken = fail[node], pops[node]
                while at >= 0 and at << 8 | byte not in child:
                    taken += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[to], pops[to] = child[at << 8 | byte], taken

    def count(self, word: bytes) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        node = taken = 0
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                taken += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            taken += pops[node]
            node = fail[node]
        return taken


class Counter(dict):
    """Counts by word, remembered as long as there is room."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        super().__init__()
        self.automaton = Automaton(tokens)

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


_counters: dict[bytes, Counter] = {}


def counter(tokens: list[bytes]) -> Counter:
    """One for each Python worker."""
    key = hashlib.sha256(b"\n".join(tokens)).digest()
    if key not in _counters:
        _counters[key] = Counter(tokens)
    return _counters[key]


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: lines of a base64 token and its rank."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


def _counts(batches: Iterable[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    by_word = counter(tokens).__getitem__
    for batch in batches:
        n_words, n_tokens = [], []
        for text in batch.column(1):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            n_tokens.append(sum(map(by_word, words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs`` (doc_id, text, ...); ``path`` is a rank file.

    A word that the vocabulary can't cover counts as one token. A null or blank text has 0 words
    and tokens. Rows without doc_id and repeated rows stay; other columns are ignored. An empty
    table gives an empty result. There is no shuffle: one pass over the texts.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: lean(_counts(batches, tokens.value)), f"doc_id {kind}, n_words long, n_tokens long")
