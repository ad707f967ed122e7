"""Byte-level BPE encoding and decoding.

Pre-tokens are merged with a priority queue of merge ranks over a doubly linked list of symbols;
queue entries whose symbols have changed since they were pushed are stale and are skipped. Decoding
concatenates vocabulary strings. A null text counts as empty; an empty text has no ids. Repeated rows
give repeated results; columns other than key and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_texts

#: Fixed value: how byte-level BPE splits text. White space is spelt out, as \s of the regex module has more.
_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: The same for texts of Latin-1 characters alone, for which the faster module does.
_L, _N, _W = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_SPLIT_LATIN = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_W}{_L}{_N}]+|[{_W}]+(?![^{_W}])|[{_W}]+")

#: A pair that has no merge.
_NONE = (-1, -1)


def split(text: str) -> list[str]:
    """Pre-tokens of a text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT.findall(text)
    return _SPLIT_LATIN.findall(text)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of pre-tokens and their ids that a worker remembers.
MEMORY_BYTES = 96 << 20


class BytePairCodec:
    """Encoder and decoder for one vocabulary file, with a bounded memory of pre-tokens seen."""

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        #: left id and right id in one number -> (rank, merged id)
        self.ranks = {vocab[a] << 16 | vocab[b]: (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        letters = byte_alphabet()
        self.first = [vocab[letters[b]] for b in range(256)]
        back = {c: b for b, c in letters.items()}
        self.strings = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in piece if c in back)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.added.items():
            self.strings[i] = piece.encode()
        marks = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(marks) + ")") if marks else None
        self.packed = _Memory(self._pack, memory)
        self.packed_added = {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        get = self.ranks.get
        #: rank of the pair that starts at each symbol, and its merged id
        now = [get(a << 16 | b, _NONE) for a, b in zip(ids, ids[1:])]
        now.append(_NONE)
        queue = [r[0] << 32 | i for i, r in enumerate(now) if r is not _NONE]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            rank, made = now[i]
            if rank != top >> 32:
                continue  # stale: this pair has changed since it was pushed
            j = after[i]
            ids[i], ids[j], now[j] = made, -1, _NONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = r = get(made << 16 | ids[k], _NONE)
                if r is not _NONE:
                    heappush(queue, r[0] << 32 | i)
            else:
                now[i] = _NONE
            h = before[i]
            if h >= 0:
                now[h] = r = get(ids[h] << 16 | made, _NONE)
                if r is not _NONE:
                    heappush(queue, r[0] << 32 | h)
        return [x for x in ids if x >= 0]

    def _pack(self, word: str) -> bytes:
        return np.array(self.merge(word.encode("utf-8")), "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.packed.__getitem__
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join(map(get, split(text)))
        out = []
        for part in self.cut.split(text):
            mark = self.packed_added.get(part)
            out.append(mark if mark else b"".join(map(get, split(part))))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Memory(dict):
    """Results by key; emptied when they take so many bytes, about, so that its size stays bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        made = self.make(key)
        if len(key) <= 64:
            if self.held >= self.most:
                self.clear()
                self.held = 0
            self[key] = made
            # A text, a byte string and a slot of the table, as Python holds them.
            self.held += 190 + 4 * len(key) + (len(made) if isinstance(made, bytes) else 0)
        return made


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (array<int>); with ``digests`` hashes of ids and decoded text instead of ids."""
    fields = [T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def make():
        c = codec(path)

        def run(texts: list) -> list[list]:
            packed = [c.encode_packed(t or "") for t in texts]
            counts = [len(p) // 4 for p in packed]
            if not digests:
                return [counts, [np.frombuffer(p, "<u4").astype("i4") for p in packed]]
            decoded = [c.decode_bytes(p).decode("utf-8", "replace").encode("utf-8") for p in packed]
            return [counts, [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(d).hexdigest() for d in decoded]]

        return run

    return append_columns(as_texts(docs, id_col, text_col), ["text"], fields, make).drop("text")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and text decoded from an array of ids; a null array gives an empty text, a null id nothing."""
    from pyspark.sql import functions as F

    def make():
        c = codec(path)
        return lambda rows: [[c.decode([i for i in ids or [] if i is not None]) for ids in rows]]

    given = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return append_columns(given, ["ids"], [T.StructField("text", T.StringType())], make).drop("ids")
