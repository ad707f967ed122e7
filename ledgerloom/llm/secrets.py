"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the three-byte strings that any match must hold.
Texts are indexed in segments: postings map each trigram that some query asks for to the texts of the
segment that hold it. A query intersects and unites postings; only the texts that it leaves are matched
against the regex. A rule without mandatory trigrams scans all texts of the segment. The index folds
ASCII case, so it may leave a text too many but never one too few.

A null text counts as empty; an empty text has no findings. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, as_texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    least: int = 0  #: characters of the group below
    group: int = 0
    base: bool = False

    def find(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, 0, True),
    # The runs of 24 and more are those of [0-9a-f]+ that are long enough.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, 0, True),
)
#: What may stand between the lines of a key: also escaped line ends, quotes and marks of quoted lines.
_GAP = r"""(?:\s|\\[nrt]|["'>#|,])*+"""
#: A key's body: all up to its footer or else, after header fields, its base64 lines; only the last one may be short.
_BODY = rf"""(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----|(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash):[^\n\\]*+)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})+(?:{_GAP}[A-Za-z0-9+/]++(?:=|(?=\s*(?:[\r\n]|\Z)|\\[nr]|["']))=?)?)?"""
MORE = (
    Rule("hex_upper", r"[0-9A-F]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----" + _BODY),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{0,20}://[^/\s:@]++:[^/\s:@]++@"),
    Rule("npm", r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{36}"),
    Rule("bearer", r"(?:Bearer|bearer) [A-Za-z0-9_.~+/-]{20,}=*"),
)
RULES = BASE + MORE

#: Queries: True (all texts), a trigram, ("and", [...]) or ("or", [...]).
_MOST = 64


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean query that every text with a match fulfils, over lower-cased trigrams."""
    tree = sre_parser.parse(pattern, flags)
    return _simple(_walk(tree))


def _of_strings(strings: set[str]):
    """Any of the strings stands in the text."""
    if not strings or any(len(s.encode()) < 3 for s in strings):
        return True
    each = []
    for s in sorted(strings):
        b = s.encode()
        each.append(("and", [b[i : i + 3] for i in range(len(b) - 2)]))
    return ("or", each)


def _walk(items):
    """A sequence of parsed items: texts are joined for as long as they are few; then they become a query."""
    parts, run = [], {""}

    def end():
        nonlocal run
        parts.append(_of_strings(run))
        run = {""}

    for item in items:
        got = _exact(item)
        if got is not None and len(run) * len(got) <= _MOST:
            run = {a + b for a in run for b in got}
        else:
            end()
            if got is not None:
                run = got
            else:
                parts.append(_query(item))
    end()
    return ("and", parts)


def _exact(item) -> set[str] | None:
    """All strings that an item can match, lower-cased, if they are few and known."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 4:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if 0 < len(out) <= 6 else None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op is sre.BRANCH:
        each = [_exact_all(x) for x in arg[1]]
        return set().union(*each) if all(e is not None for e in each) and sum(map(len, each)) <= _MOST else None
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        one = _exact_all(arg[2])
        if one is None or len(one) ** int(arg[1]) > _MOST:
            return None
        out, power = set(), {""}
        for n in range(int(arg[1]) + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
        return out
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    return None


def _exact_all(items) -> set[str] | None:
    run = {""}
    for item in items:
        got = _exact(item)
        if got is None or len(run) * len(got) > _MOST:
            return None
        run = {a + b for a in run for b in got}
    return run


def _query(item):
    op, arg = item
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        return ("or", [_walk(x) for x in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
        return _walk(arg[2])
    return True


def _simple(q):
    if q is True or isinstance(q, bytes):
        return q
    op, parts = q
    parts = [_simple(p) for p in parts]
    if op == "or":
        if any(p is True for p in parts) or not parts:
            return True
    else:
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    flat = []
    for p in parts:
        flat += p[1] if not isinstance(p, bytes) and p[0] == op else [p]
    return flat[0] if len(flat) == 1 else (op, flat)


def trigrams_of(q) -> set[bytes]:
    if q is True:
        return set()
    return {q} if isinstance(q, bytes) else set().union(*map(trigrams_of, q[1]))


class SegmentIndex:
    """Postings of one segment of texts, for the trigrams asked for."""

    def __init__(self, asked: list[bytes]):
        self.asked = asked
        self.slot = np.zeros(1 << 24, np.uint8 if len(asked) < 256 else np.uint16)
        for i, t in enumerate(asked):
            self.slot[int.from_bytes(t, "big")] = i + 1

    def build(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        data = [t.encode("utf-8", "replace").lower() + b"\0\0" for t in texts]
        starts = np.cumsum([0, *map(len, data)])[:-1]
        b = np.frombuffer(b"".join(data), np.uint8)
        if len(b) < 3:
            return {}
        code = b[:-2].astype(np.uint32)
        code <<= 8
        code |= b[1:-1]
        code <<= 8
        code |= b[2:]
        hit = self.slot[code]
        at = np.flatnonzero(hit)
        keys = np.unique(hit[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        which, doc = np.divmod(keys, len(texts))
        return {self.asked[i - 1]: doc[which == i] for i in np.unique(which).tolist()}


def candidates(q, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Texts that fulfil a query."""
    if q is True:
        return np.arange(n)
    if isinstance(q, bytes):
        return postings.get(q, np.empty(0, np.int64))
    out = candidates(q[1][0], postings, n)
    for p in q[1][1:]:
        if q[0] == "and":
            if not len(out):
                return out
            out = np.intersect1d(out, candidates(p, postings, n), assume_unique=True)
        else:
            out = np.union1d(out, candidates(p, postings, n))
    return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, segment_bytes: int = 2 << 20):
        self.rules, self.segment_bytes = rules, segment_bytes
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.index = SegmentIndex(sorted(set().union(*map(trigrams_of, self.queries))))

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans as (start, place of the rule, end), sorted."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < self.segment_bytes):
                size += len(texts[end] or "")
                end += 1
            out += self._segment([t or "" for t in texts[at:end]])
            at = end
        return out

    def _segment(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        postings = self.index.build(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, compiled, q) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in candidates(q, postings, len(texts)).tolist():
                out[i] += [(s, k, e) for s, e in rule.find(texts[i], compiled)]
        for spans in out:
            spans.sort()
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, found (array of kind, start, end in code points; end exclusive; by start, then rule)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def make():
        s = scanner(rules)

        def run(texts: list) -> list[list]:
            return [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in s.scan(texts)]]

        return run

    return append_columns(as_texts(docs, id_col, text_col), ["text"], [T.StructField("found", T.ArrayType(span))], make).drop("text")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret of a text replaced by ``mark``; overlapping spans are replaced once. Nulls stay null."""

    def make():
        s = scanner(rules)

        def clean(text, spans):
            out, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join(out) + text[at:] if spans else text

        return lambda texts: [[clean(t, spans) for t, spans in zip(texts, s.scan(texts))]]

    return append_columns(docs, [text_col], [T.StructField(text_col, T.StringType())], make).select(*docs.columns)


def spans_text(found: str = "found", kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined."""
    spans = F.col(found)
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
