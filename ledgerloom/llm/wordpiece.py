"""Token counts by greedy longest match.

A trie over the vocabulary gets failure links and, with each link, the number of pieces that taking it
pops, so that one pass over the bytes of a word gives its piece count without building a piece. Word
starts and word continuations are two tries in one automaton, as in word-piece vocabularies.
A null text counts as empty. A word that the vocabulary cannot cover counts as one unknown token.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import MEMORY_BYTES, _Memory, byte_alphabet
from .common import append_columns, as_texts


class LongestMatchCounter:
    """Counts pieces of words; ``starts`` are pieces at a word's start, ``continuations`` those after it."""

    def __init__(self, starts: list[bytes], continuations: list[bytes], memory: int = MEMORY_BYTES):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for p in pieces:
                at = root
                for b in p:
                    to = self.next[at].get(b)
                    if to is None:
                        to = self.next[at][b] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = to
                piece[at] = at > 1
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        #: breadth first, as a link of a node is made from links of nodes nearer to the root
        todo = deque([0, 1])
        while todo:
            parent = todo.popleft()
            for b, node in self.next[parent].items():
                if piece[node]:
                    self.fail[node], self.popped[node] = 1, 1
                else:
                    at, n = self.fail[parent], self.popped[parent]
                    while at != -1 and b not in self.next[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at != -1:
                        self.fail[node], self.popped[node] = self.next[at][b], n
                todo.append(node)
        self.counts = _Memory(self.count_word, memory)

    def count_word(self, word: bytes) -> int:
        """Pieces of one word; 1 for a word that cannot be covered, 0 for an empty one."""
        at, n = 0, 0
        nexts, fail, popped = self.next, self.fail, self.popped
        if not word:
            return 0
        for b in word:
            while b not in nexts[at]:
                n += popped[at]
                at = fail[at]
                if at == -1:
                    return 1
            at = nexts[at][b]
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at == -1:
                return 1
        return n


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Start and continuation pieces of a byte-level vocabulary file: pieces with and without the mark of a leading space.

    Every byte alone is a start too, as a word may begin with any.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in byte_alphabet().items()}
    pieces = [bytes(back[c] for c in p if c in back) for p in vocab]
    starts = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    return starts + [bytes([b]) for b in range(256)], [p for p in pieces if p and p[:1] != b" "]


_counters: dict[str, LongestMatchCounter] = {}


def counter(path: str) -> LongestMatchCounter:
    if path not in _counters:
        _counters[path] = LongestMatchCounter(*vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words (runs between ASCII white space), n_tokens, n_bytes (UTF-8)."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_bytes")]

    def make():
        get = counter(path).counts.__getitem__

        def run(texts: list) -> list[list]:
            data = [(t or "").encode("utf-8") for t in texts]
            words = [d.split() for d in data]
            return [[len(w) for w in words], [sum(map(get, w)) for w in words], [len(d) for d in data]]

        return run

    return append_columns(as_texts(docs, id_col, text_col), ["text"], fields, make).drop("text")
