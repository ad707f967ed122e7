"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the runs of text between tags that are not inline. Each block is a vector of its tag path (names
of tags, words of classes, ids and roles of all elements around it, once more those of the nearest that has any, hashed), of its words (hashed), and of a few measures. A
bidirectional LSTM in numpy reads the blocks of a page in order, whole pages at a time, so each block is judged in the
context of the whole document, and says which blocks are main text.

The network is trained here, on pages that ``made_page`` lays out by a fixed grammar: menus, headers, footers, sidebars,
notices, adverts, forms and comments under many names around and within an article. Their words come from at most
``MAX_PAGES`` of the given pages, in the order of a hash of their ids; ``TRAIN_PAGES`` are made. Every given page is labelled.

Markup, scripts, styles, templates and comments are left out whatever the labels say. Character references are decoded,
white space (as of ``str.split``) within a block becomes one space; ``<br>`` counts as white space. Blocks are joined by one
line end in page order; nothing else is left out or cut. Tags that are never closed end with what is around them; a tag
that breaks off at the end of a page is left out. A null, empty or text-free page has an empty text. Repeated rows are
worked on one by one, and their order is that of the input. An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, unused

MAX_PAGES = 256
TRAIN_PAGES = 3000
EPOCHS = 4
PATH_BUCKETS, WORD_BUCKETS = 2048, 1024
PATH_SIZE, WORD_SIZE, HIDDEN = 32, 12, 20
#: Pages that are read side by side.
SIDE_BY_SIDE = 128

# Elements as HTML has them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i img ins kbd label mark meter nobr output progress q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source track area embed param".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp svg math object audio video canvas".split())
#: What the start of an element closes, if it is open within the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody"}, {"table"}),
}
TELLING = frozenset("article main nav header footer aside form menu dialog fieldset".split())
#: Elements that an end tag of another element within them does not leave.
BOUNDS = frozenset("table td th body html".split())

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"(?:[^\"<>]*|[^\"]{0,2000})\"|'(?:[^'<>]*|[^']{0,2000})')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>"
    r"|<[!?/][^<>]*>"
    r"|<[a-zA-Z/!?][^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    #: Tags and words of the names of all elements around the text.
    path: frozenset[str]
    #: The innermost elements, from the inside.
    leaf: tuple[str, str]
    #: Tag and name words of the innermost element that says what it is for, by its name or its tag.
    near: tuple[str, ...]
    #: Share of characters within links.
    linked: float


def name_words(attributes: str) -> list[str]:
    """Words of classes, ids and roles."""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("c:hidden")
        elif name != "style" and name != "aria-hidden":
            out += [f"c:{w.lower()}" for w in _NAME_PART.findall(value)]
    return out


def blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page, in order."""
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    inside: list[frozenset[str]] = []  # of inline elements in the block so far
    stack: list[tuple[str, frozenset[str], tuple[str, ...]]] = [("", frozenset(), ())]
    links, linked, size = 0, 0, 0
    at, n = 0, len(page)

    def end() -> None:
        nonlocal links, linked, size
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = stack[-1][1].union(*inside) if inside else stack[-1][1]
                out.append(Block(text, path, (stack[-1][0], stack[-2][0] if len(stack) > 1 else ""), stack[-1][2], linked / max(1, size)))
            parts.clear()
        inside.clear()
        links = linked = size = 0

    def text(raw: str) -> None:
        nonlocal linked, size
        s = html.unescape(raw) if "&" in raw else raw
        parts.append(s)
        size += len(s)
        linked += len(s) if links else 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if name not in ("svg", "math", "audio", "video", "canvas", "object") or not attributes.endswith("/"):
                close = _ENDS[name].search(page, at)
                at = close.end() if close else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            if not closing and attributes and (own := name_words(attributes)):
                inside.append(frozenset(own))
            continue
        end()
        if closing:
            for i in range(len(stack) - 1, max(0, len(stack) - 512), -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in BOUNDS and name not in BOUNDS and name not in ("tr", "tbody", "thead", "tfoot"):
                    break
            continue
        closes, bounds = CLOSES.get(name, (frozenset(), frozenset()))
        if stack[-1][0] == "p":
            stack.pop()
        if closes:
            for i in range(len(stack) - 1, max(0, len(stack) - 512), -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in closes:
                    del stack[i:]
                    break
        if name not in VOID:
            _, above, near = stack[-1]
            own = (f"t:{name}", *(name_words(attributes) if attributes else ()))
            stack.append((name, above if above.issuperset(own) else above.union(own), own if len(own) > 1 or name in TELLING else near))
    end()
    return out


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


class Remembered(dict):
    """Buckets of words that a task has met, forgotten when there are many."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17 or len(word) > 100:
            self.clear()
        b = self[word] = _bucket(word, self.n)
        return b


MEASURES = 8


class Vectors:
    """Hashed paths and words of blocks, as flat arrays with the number of each block's."""

    def __init__(self):
        self.paths, self.words = Remembered(PATH_BUCKETS), Remembered(WORD_BUCKETS)

    def of(self, page: Sequence[Block]) -> tuple[list[int], list[int], list[int], list[int], list[list[float]]]:
        path, n_path, word, n_word, measures = [], [], [], [], []
        for b in page:
            own = [self.paths[p] for p in sorted(b.path)]
            own += [self.paths[f"n:{p}"] for p in b.near]
            own += [self.paths[f"l:{b.leaf[0]}"], self.paths[f"m:{b.leaf[1]}>{b.leaf[0]}"]]
            path += own
            n_path.append(len(own))
            found = _WORD.findall(b.text.lower()) or [b.text[:20]]
            word += [self.words[w] for w in found]
            n_word.append(len(found))
            n = len(b.text)
            measures.append([np.log1p(n) / 8, np.log1p(len(found)) / 6, b.linked, float(b.text[-1] in ".!?…\"'”»"), (b.text.count(",") + b.text.count(".")) * 10 / (n + 10), sum(map(str.isdigit, b.text[:200])) / 200, float(b.text[0] in "©®|»«›·•"), 1.0])
        return path, n_path, word, n_word, measures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """The network: hashed vectors, an LSTM each way, and a logistic unit over both states of a block."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "path": make(PATH_BUCKETS, PATH_SIZE, scale=0.3), "word": make(WORD_BUCKETS, WORD_SIZE, scale=0.3),
            "w": make(2, size, 4 * HIDDEN, scale=size**-0.5), "u": make(2, HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "v": make(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32),
        }
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def inputs(self, vectors) -> np.ndarray:
        path, n_path, word, n_word, measures = vectors
        sums = lambda table, index, n: np.add.reduceat(table[index], np.cumsum(n) - n)
        n_word = np.asarray(n_word)
        x = [sums(self.p["path"], path, np.asarray(n_path)), sums(self.p["word"], word, n_word) / n_word[:, None], np.asarray(measures)]
        return np.concatenate(x, 1).astype(np.float32)

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of blocks, which stand page after page in ``x``; what a backward pass needs comes with ``keep``."""
        n, steps = len(lengths), int(lengths.max())
        first = np.cumsum(lengths) - lengths
        step = np.arange(len(x)) - np.repeat(first, lengths)
        page = np.repeat(np.arange(n), lengths)
        back = np.repeat(lengths, lengths) - 1 - step  # step of a block when read backwards
        both = np.zeros((steps, 2, n, x.shape[1]), np.float32)
        both[step, 0, page], both[back, 1, page] = x, x
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)
        trace = []
        for t in range(steps):
            z = both[t] @ self.p["w"] + h @ self.p["u"] + self.p["b"]
            i, f, o = _sigmoid(z[..., :HIDDEN]), _sigmoid(z[..., HIDDEN : 2 * HIDDEN]), _sigmoid(z[..., 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[..., 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            held = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, before, held, h))
            h = o * held
            states[t] = h
        out = np.concatenate([states[step, 0, page], states[back, 1, page]], 1)
        return out @ self.p["v"] + self.p["c"], {"both": both, "trace": trace, "out": out, "at": (step, back, page)} if keep else {}

    def gradients(self, vectors, lengths: np.ndarray, truth: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over blocks, back through time. ``there``: 0 for parts of the input that are left out,
        which keeps the network from going by the words of a few blocks alone."""
        path, n_path, word, n_word, _ = vectors
        logits, kept = self.forward(self.inputs(vectors) * there, lengths, keep=True)
        d = ((_sigmoid(logits) - truth) / len(truth)).astype(np.float32)
        step, back, page = kept["at"]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["v"], grad["c"] = kept["out"].T @ d, d.sum(keepdims=True)
        steps, n = len(kept["trace"]), len(lengths)
        outer = np.zeros((steps, 2, n, HIDDEN), np.float32)
        outer[step, 0, page] = d[:, None] * self.p["v"][:HIDDEN]
        outer[back, 1, page] = d[:, None] * self.p["v"][HIDDEN:]
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        dx = np.empty_like(kept["both"])
        turn = lambda a: a.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, held, h = kept["trace"][t]
            dh = dh + outer[t]
            dc = dc + dh * o * (1 - held * held)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * held * o * (1 - o), dc * i * (1 - g * g)], -1)
            grad["w"] += turn(kept["both"][t]) @ dz
            grad["u"] += turn(h) @ dz
            grad["b"] += dz.sum(1, keepdims=True)
            dx[t] = dz @ turn(self.p["w"])
            dh, dc = dz @ turn(self.p["u"]), dc * f
        own = (dx[step, 0, page] + dx[back, 1, page]) * there
        np.add.at(grad["path"], path, np.repeat(own[:, :PATH_SIZE], n_path, 0))
        np.add.at(grad["word"], word, np.repeat(own[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.asarray(n_word)[:, None], n_word, 0))
        return grad

    def main(self, pages: Sequence[Sequence[Block]], vectors: Vectors | None = None) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length are read side by side."""
        vectors = vectors or Vectors()
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for at in range(0, len(order), SIDE_BY_SIDE):
            part = order[at : at + SIDE_BY_SIDE]
            lengths = np.array([len(pages[i]) for i in part])
            made = vectors.of([b for i in part for b in pages[i]])
            logits, _ = self.forward(self.inputs(made), lengths)
            for i, own in zip(part, np.split(logits > 0, np.cumsum(lengths)[:-1])):
                out[i] = own
        return out


def train(pages: Sequence[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 3, at_once: int = 50) -> Labeller:
    """Adam over made pages, whose blocks begin with the marks of ``made_page``."""
    vectors, rows = Vectors(), []
    for p in pages:
        found = [b for b in blocks(p) if b.text[0] in (MAIN, REST)]
        truth = [b.text[0] == MAIN for b in found]
        for b in found:
            b.text = b.text.replace(MAIN, "").replace(REST, "").strip() or "-"
        if found:
            rows.append((found, truth))
    net, rng, chance = Labeller(seed), random.Random(seed), np.random.default_rng(seed)
    rows.sort(key=lambda r: len(r[0]))
    groups = [rows[i : i + at_once] for i in range(0, len(rows), at_once)]
    made = [(vectors.of([b for found, _ in g for b in found]), np.array([len(found) for found, _ in g]), np.array([t for _, truth in g for t in truth], np.float32)) for g in groups]
    m, v, t = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(made)
        step = rate * (1 - 0.8 * epoch / epochs)
        for g in made:
            t += 1
            there = np.ones((len(g[2]), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
            there[:, PATH_SIZE:] = chance.random((len(g[2]), 1)) < 0.5
            for k, d in net.gradients(*g, there).items():
                d = np.clip(d, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                net.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


# Marks of blocks in made pages, from the private use area.
MAIN, REST = "", ""

#: Names by which pages mark what is not main text, by kind: elements, then classes and ids.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "menu": (("nav", "nav", "div", "ul", "menu"), ("nav", "navbar", "menu", "main-menu", "topnav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "tabs", "toc", "links", "tags", "site-nav", "skip")),
    "header": (("header", "header", "div"), ("header", "masthead", "topbar", "branding", "logo", "site-header", "site-title", "page-header", "tagline", "top")),
    "footer": (("footer", "footer", "div"), ("footer", "site-footer", "colophon", "copyright", "legal", "bottom", "foot", "credits", "page-footer")),
    "sidebar": (("aside", "aside", "div", "section"), ("sidebar", "side", "rail", "right-rail", "widget", "widget-area", "related", "related-posts", "trending", "popular", "recommended", "more-stories", "also-read", "secondary", "teaser", "promo-list")),
    "notice": (("div", "div", "section", "p", "dialog", "aside"), ("cookie", "cookie-banner", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "disclaimer", "announcement", "warning", "paywall", "banner", "site-notice", "privacy-notice", "message")),
    "advert": (("div", "div", "aside", "ins", "section", "p"), ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adsbygoogle", "banner-ad", "ad-slot", "ad-container", "commercial")),
    "form": (("form", "form", "div", "fieldset"), ("form", "search", "search-form", "login", "signup", "newsletter", "subscribe", "contact", "contact-form", "register")),
    "comments": (("section", "div", "div", "ol", "aside"), ("comments", "comment", "comment-list", "comments-area", "respond", "replies", "discussion", "disqus", "reader-comments", "user-comments", "feedback", "responses", "reviews")),
    "share": (("div", "ul", "p"), ("share", "social", "sharing", "share-buttons", "follow", "social-links", "post-meta-share")),
}
#: Names by which pages mark their main text.
ARTICLE = ("content", "post", "entry", "entry-content", "article", "article-body", "story", "story-body", "text", "body-text", "main", "main-content", "post-content", "page-content", "blog-post")
NEUTRAL = ("wrapper", "container", "page", "site", "row", "col", "inner", "wrap", "layout", "clearfix", "grid", "app", "root")
STOCK = "home about contact login search subscribe news sports archive privacy terms cookies accept more next previous read share follow reply comments sponsored advertisement copyright rights reserved sign up email submit menu".split()


def made_page(rng: random.Random, words: Sequence[str]) -> str:
    """A page by the grammar; each block of text begins with MAIN or REST."""

    def said(least: int, most: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))

    def sentences(least: int, most: int) -> str:
        return " ".join(f"{said(3, 18).capitalize()}{rng.choice(['.', '.', '.', '!', '?', ''])}" for _ in range(rng.randint(least, most)))

    def named(names: Sequence[str], chance: float) -> str:
        if rng.random() >= chance:
            return ""
        name = rng.choice(names)
        if rng.random() < 0.15:
            name = name.replace("-", "_") if rng.random() < 0.5 else "".join(p.capitalize() if i else p for i, p in enumerate(name.split("-")))
        if rng.random() < 0.2:
            name += f" {rng.choice(NEUTRAL)}-{rng.randint(1, 12)}"
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}"'

    def short() -> str:
        return rng.choice([said(1, 3), rng.choice(STOCK).capitalize(), f"{rng.choice(STOCK).capitalize()} {rng.choice(STOCK)}"])

    def rest(kind: str) -> str:
        tags, names = KINDS[kind]
        tag = rng.choice(tags)
        telling = tag in ("nav", "header", "footer", "aside", "form", "menu")
        open_ = f"<{tag}{named(names, 0.45 if telling else 1.0)}>"
        link = lambda: f'<a href="/{rng.randint(1, 99)}">{REST}{short()}</a>'
        block = lambda s: rng.choice([f"<p>{REST}{s}</p>", f"<div>{REST}{s}</div>", f"<span>{REST}{s}</span>", f"{REST}{s}"])
        if tag == "p":  # a block within it would close it
            inner = f"{REST}{rng.choice([sentences(1, 3), short()])}"
        elif kind in ("menu", "share") or kind == "sidebar" and rng.random() < 0.5 or kind == "footer" and rng.random() < 0.3:
            items = [link() if rng.random() < 0.85 else f"{REST}{short()}" for _ in range(rng.randint(2, 9))]
            if tag in ("ul", "menu"):
                inner = "".join(f"<li>{i}</li>" for i in items)
            else:
                inner = rng.choice([f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", "".join(f"<div>{i}</div>" for i in items), f"<h3>{REST}{short()}</h3><ul>{''.join(f'<li>{i}' for i in items)}</ul>"])
        elif kind == "form":
            inner = rng.choice(["", f"<label>{REST}{short()}</label>"]) + f'<input type="text"><button>{REST}{short()}</button>' + rng.choice(["", f"<p>{REST}{sentences(1, 2)}</p>", f"<select><option>{REST}{short()}<option>{REST}{short()}</select>"])
        elif kind == "comments":
            one = lambda: rng.choice([f'<div class="comment"><b>{REST}{short()}</b><p>{REST}{sentences(1, 5)}</p></div>', f"<li><p>{REST}{sentences(1, 6)}</p></li>", f'<article class="comment"><p>{REST}{sentences(1, 5)}</p></article>', f"<p>{REST}{sentences(1, 6)}</p>", f"<div>{REST}{sentences(1, 4)}</div>"])
            inner = rng.choice(["", f"<h2>{REST}{short()}</h2>", f"<h3>{REST}{rng.randint(1, 40)} {short()}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 6)))
        elif kind == "header":
            inner = rng.choice([f"<h1>{REST}{short()}</h1>", f"<p>{REST}{short()}</p>", link(), block(said(1, 5))]) + rng.choice(["", block(said(2, 8)), rest("menu")])
        elif kind == "footer":
            inner = block(rng.choice(["&copy; ", "© ", ""]) + said(1, 4) + rng.choice([" &middot; ", " | ", ". "]) + rng.choice([sentences(1, 2), said(1, 6)])) + rng.choice(["", block(sentences(1, 2)), rest("menu")])
        elif kind == "sidebar":
            inner = rng.choice(["", f"<h3>{REST}{short()}</h3>"]) + "".join(block(sentences(1, 3)) for _ in range(rng.randint(1, 4)))
        else:
            inner = "".join(block(sentences(1, 3) if rng.random() < 0.75 else short()) for _ in range(rng.choice([1, 1, 2])))
        return f"{open_}{inner}</{tag}>"

    def paragraph() -> str:
        s = rng.choice([sentences(1, 12), sentences(1, 3), said(1, 3).capitalize() + ".", said(1, 6), f"{rng.choice(STOCK).capitalize()} {said(1, 3)}", "All rights reserved.", " ".join([said(1, 2)] * rng.randint(1, 30)), said(1, 8).upper() + "!!"])
        return rng.choice([
            *[f"<p>{MAIN}{s}</p>"] * 8, f"<p>{MAIN}{s}", f"<p><b>{MAIN}{s}<br><p>{MAIN}{sentences(1, 3)}</p>", f"<p>{MAIN}{said(1, 5)} <a href='/x'>{said(1, 3)}</a> {s}</p>", f"<h2>{MAIN}{said(1, 7)}</h2>",
            f"<ul>{''.join(f'<li>{MAIN}{said(1, 14)}</li>' for _ in range(rng.randint(1, 5)))}</ul>", f"<blockquote><p>{MAIN}{s}</p></blockquote>", f"<blockquote>{MAIN}{s}</blockquote>", f"<figure><img src='a.png'><figcaption>{MAIN}{said(2, 12)}</figcaption></figure>",
            f"<pre>{MAIN}{said(2, 20)}</pre>", f"<div>{MAIN}{s}</div>", f"<table><tr><td>{MAIN}{said(1, 4)}</td><td>{MAIN}{said(1, 4)}</td></tr></table>", f"<section><h3>{MAIN}{said(1, 6)}</h3><p>{MAIN}{s}</p></section>",
        ])

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "div", "section", "td"])
        title = f"<h1>{MAIN}{rng.choice([said(1, 14), said(3, 9).capitalize() + '.'])}</h1>"
        inner = [rng.choice([title, title, title, "", f"<header>{title}</header>"])] + [paragraph() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 13, 20]))]
        if not any(inner):
            inner = [paragraph()]
        for kind in ("advert", "share", "sidebar", "form", "notice", "menu"):
            if rng.random() < 0.2:
                inner.insert(rng.randint(1, len(inner)), rest(kind))
        if rng.random() < 0.12:
            inner.append(rest("comments"))
        if rng.random() < 0.1:
            inner += [f"<p>{MAIN}{said(1, 4).capitalize()}.</p>"] * rng.randint(1, 9)
        body = f"<{tag}{named(ARTICLE, 0.3 if tag in ('article', 'main') else 0.97)}>{''.join(inner)}</{tag}>"
        if tag == "td":
            body = f"<table><tr>{body}</tr></table>"
        if tag == "article" and rng.random() < 0.3:
            body = f"<main>{body}</main>"
        return body

    before = [k for k in ("notice", "header", "menu", "advert", "form", "menu", "notice") if rng.random() < 0.4]
    after = [k for k in ("share", "advert", "comments", "sidebar", "form", "footer", "notice", "advert") if rng.random() < 0.4]
    rng.shuffle(before)
    if rng.random() < 0.3:
        rng.shuffle(after)
    if rng.random() < 0.25:
        before, after = ["menu", "advert"], ["footer"]
    around = [f"<div{named(NEUTRAL, 0.8)}>" for _ in range(rng.choice([0, 0, 1, 2]))]
    middle = article() if rng.random() < 0.97 else ""
    inner = [*map(rest, before), *around, middle] + ([rest("sidebar")] if rng.random() < 0.15 else []) + ["</div>"] * len(around) + list(map(rest, after))
    return f"<html><head><title>x</title></head><body{named((*NEUTRAL, "home", "single", "post", "article-page"), 0.3)}>{''.join(inner)}" + rng.choice(["</body></html>", ""])


def word_pool(pages: DataFrame, id_col: str, html_col: str, most: int) -> list[str]:
    """Words of at most ``most`` pages, those first by a hash of their ids."""
    place = F.xxhash64(F.col(id_col), F.col(html_col))
    there = pages.where(F.length(html_col) > 0)
    # Hashes first, so that tasks send no pages that are not taken.
    last = there.select(place.alias("p")).orderBy("p").limit(most).agg(F.max("p")).first()[0]
    rows = there.where(place <= last).select(F.substring(F.col(html_col).cast("string"), 1, 20_000).alias("h")).limit(most).collect() if last is not None else []
    words = [w for r in rows for b in blocks(r.h) for w in b.text.split() if len(w) < 40 and "<" not in w and "&" not in w]
    rng = random.Random(1)
    return rng.sample(words, 20_000) if len(words) > 20_000 else words or ["lorem", "ipsum", "dolor", "sit", "amet"]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller trained on made pages with words of at most ``max_pages`` given ones."""
    words = word_pool(pages, id_col, html_col, max_pages)
    rng = random.Random(2)
    return train([made_page(rng, words) for _ in range(train_pages)], epochs)


def main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each; a column of that name is replaced."""
    model = model or fit(pages, id_col, html_col)

    def make():
        vectors = Vectors()

        def texts(pages: list[str | None]) -> list:
            cut = [blocks(p) for p in pages]
            return [["\n".join(b.text for b, keep in zip(found, own) if keep) for found, own in zip(cut, model.main(cut, vectors))]]

        return texts

    return append_columns(pages, [html_col], [T.StructField(out_col, T.StringType())], make)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    done = main_text(rows, out_col=unused(rows, "text"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
