"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: the text between block-level tags, with
the path of open elements.  A bidirectional LSTM in numpy reads hashed vectors of path
and words for the whole sequence, so that every block is judged with the page around
it, and labels it as article or not.  It learns from page layouts that
:func:`sample_layout` composes around texts of the given pages, so that no page has to be
labelled by hand.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS

# HTML elements by how they are laid out.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
#: An element is closed by one of its kind or of those it may not hold.
CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
_P_ENDERS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main nav ol p pre section table ul".split()
)
_P, _NONE = frozenset({"p"}), frozenset()
_SCOPE = frozenset("article aside blockquote body div footer form header main nav section table td ul ol".split())

#: Where a comment, a declaration or a tag begins; no character is read twice.
_OPEN = re.compile(r"<(?:(!--|!\[CDATA\[|[!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
#: What a tag holds up to its end; a quote that is never closed is a character like others.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+")
_ENDS = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
#: Where markup begins in a page's end that closes no tag any more.
_CUT = re.compile(r"<(?:[!?]|[a-zA-Z][a-zA-Z0-9:-]*+\s++[^\s<>=/\"']++\s*+=)")
_NUMBER = re.compile(r"&#0*+([0-9]*+)(;?)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Blocks whose vectors are laid out at once.
_FEW = 4096
PATH_SLOTS = 2048
WORD_SLOTS = 1024
DIM = 16
MEASURES = 5
HIDDEN = 16
#: Pages whose texts the layouts are composed of, and layouts learned from.
SAMPLE_PAGES = 200
#: Characters of a sampled page that give words to layouts; extraction reads whole pages.
SAMPLE_CHARS = 20_000
LAYOUTS = 1500
#: How many times slower words learn than the rest.
WORD_RATE = 40
#: Share of layouts whose article stands in elements without a name.
BARE = 0.25
EPOCHS = 10


@dataclass
class Block:
    """A leaf's text and the slots of its path and words."""

    text: str
    path: tuple[int, ...]
    link_share: float


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % slots


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to a path: its tag, and the parts of its class, id and role."""
    if not attributes:
        return (tag,)
    found = [tag]
    for name, *values in _ATTRIBUTE.findall(attributes):
        parts = _PART.findall("".join(values))
        found += [f"{'role' if name.lower() == 'role' else 'of'}:{x.lower()}" for x in parts]
    return tuple(found)


def _plain(text: str) -> str:
    """Character references decoded, white space made one space and trimmed."""
    try:
        text = html.unescape(text)
    except ValueError:  # a reference of thousands of digits
        short = lambda m: "\ufffd" if len(m[1]) > 7 else f"&#{m[1]}{m[2]}"
        text = html.unescape(_NUMBER.sub(short, text))
    return " ".join(text.split())


class Open:
    """The elements open at a place of a page; all steps take constant time per name.

    Kept besides the elements themselves: where each tag is open, which of them nothing
    reaches beyond, and how often each slot of their names is on the path.
    """

    def __init__(self, slots: dict[tuple[str, ...], tuple[int, ...]]):
        self.known = slots
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.on_path: dict[int, int] = {}
        self.leaf: tuple[int, ...] | None = None

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        slots = self.known.get(names)
        if slots is None:
            if len(self.known) > 100_000:
                self.known.clear()
            slots = self.known[names] = tuple(_slot(n, PATH_SLOTS) for n in names)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _SCOPE:
            self.scopes.append(len(self.stack))
        for slot in slots:
            self.on_path[slot] = self.on_path.get(slot, 0) + 1
        self.stack.append((tag, slots))
        self.leaf = None

    def cut(self, size: int) -> None:
        """Close all elements but the outer ``size``."""
        while len(self.stack) > size:
            tag, slots = self.stack.pop()
            self.places[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            for slot in slots:
                self.on_path[slot] -= 1
                if not self.on_path[slot]:
                    del self.on_path[slot]
        self.leaf = None

    def end(self, tag: str) -> None:
        """Close the innermost element of a tag, if one is open, and all inside."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def shut(self, tags: frozenset[str]) -> None:
        """Close the innermost element of ``tags`` unless a scope stands before it."""
        place = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if place >= (self.scopes[-1] if self.scopes else 0):
            self.cut(place)

    def path(self) -> tuple[int, ...]:
        """Slots of all names on the path, and of the innermost tag as a leaf."""
        if self.leaf is None:
            last = [_slot(f"leaf:{self.stack[-1][0]}", PATH_SLOTS)] if self.stack else []
            self.leaf = (*self.on_path, *last)
        return self.leaf


class Reader:
    """Cuts pages into leaf blocks, reading each character once; keeps slots for reuse."""

    def __init__(self):
        self.slots: dict[tuple[str, ...], tuple[int, ...]] = {}

    def blocks(self, page: str | None) -> list[Block]:
        """Leaf blocks in page order; scripts, styles, forms' lists and comments are no text.

        Where no tag is closed any more, a ``<`` is text unless attributes follow its name.
        Where quotes inside a tag run to the page's end, it and all later tags end at their
        first ``>``.
        """
        page = page or ""
        found: list[Block] = []
        opened = Open(self.slots)
        pieces: list[str] = []
        inside_link = 0
        quotes = True
        chars = link_chars = 0

        def close() -> None:
            nonlocal chars, link_chars
            if pieces:
                text = _plain("".join(pieces))
                if text:
                    found.append(Block(text, opened.path(), link_chars / max(chars, 1)))
                pieces.clear()
            chars = link_chars = 0

        def take(text: str) -> None:
            nonlocal chars, link_chars
            if text:
                pieces.append(text)
                chars += len(text)
                link_chars += len(text) if inside_link else 0

        at = 0
        while match := _OPEN.search(page, at):
            take(page[at : match.start()])
            at = match.end()
            other, end, tag = match.groups()
            if other:
                stop = page.find(_ENDS[other], at)
                at = stop + len(_ENDS[other]) if stop >= 0 else len(page)
                continue
            stop = _REST.match(page, at).end() if quotes else page.find(">", at)
            if quotes and stop == len(page):
                quotes, stop = False, page.find(">", at)
            if stop < 0:
                rest = page[match.start() :]
                cut = _CUT.search(rest)
                take(rest[: cut.start()] if cut else rest)
                at = len(page)
                break
            attributes, empty, at = page[at:stop], page[stop - 1] == "/" and stop > at, stop + 1
            tag = tag.lower()
            if tag == "br":
                take(" ")
                continue
            if tag == "a":
                inside_link = 0 if end else 1
            if tag in INLINE:
                continue
            close()
            if end:
                opened.end(tag)
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                if not empty:
                    stop = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                    at = stop.end() if stop else len(page)
                continue
            opened.shut(CLOSES.get(tag, _P if tag in _P_ENDERS else _NONE))
            if not empty:
                opened.push(tag, _names(tag, attributes))
        take(page[at:])
        close()
        return found


# Names that web designs give to the parts of a page.
_PARTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "menu": (
        ("nav", "div", "ul"),
        ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toc", "tabs", "pagination", "pager"),
    ),
    "header": (("header", "div"), ("header", "masthead", "banner", "topbar", "branding", "logo", "top")),
    "footer": (("footer", "div"), ("footer", "foot", "bottom", "copyright", "legal", "colophon", "credits")),
    "sidebar": (
        ("aside", "div", "section"),
        ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more", "tags", "links", "rail", "author", "bio"),
    ),
    "notice": (
        ("div", "section", "aside"),
        ("cookie", "consent", "gdpr", "notice", "alert", "warning", "popup", "modal", "overlay", "message", "disclaimer", "banner", "privacy"),
    ),
    "advert": (
        ("div", "aside", "section", "ins"),
        ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsbygoogle", "dfp", "adslot"),
    ),
    "form": (
        ("form", "div"),
        ("form", "search", "login", "signup", "subscribe", "newsletter", "contact", "register", "poll"),
    ),
    "comments": (
        ("section", "div", "ol", "ul"),
        ("comments", "comment", "reply", "replies", "discussion", "disqus", "responses", "respond", "thread", "feedback", "reviews"),
    ),
    "share": (("div", "ul"), ("share", "social", "sharing", "follow", "buttons", "toolbar", "meta")),
}
_ARTICLE = (
    ("article", "main", "div", "section"),
    ("article", "content", "post", "entry", "body", "story", "text", "main", "page", "single", "blog", "news", "prose", "markdown", "hentry"),
)
_WRAPPERS = ("container", "wrapper", "wrap", "site", "layout", "row", "col", "inner", "outer", "root", "app", "grid")


#: Parts of a page whose tags or names leave no doubt.
_PLAIN_TAGS = {"nav": "menu", "header": "header", "footer": "footer", "form": "form", "article": "article", "main": "article"}
_PLAIN_ARTICLE = ("article", "content", "post", "entry", "story", "prose", "hentry")


def named_parts(pages: list[list[Block]]) -> dict[str, list[str]]:
    """Words of the blocks that their page names as one part alone, by part."""
    kinds: dict[int, set[str]] = {}
    names = {kind: each for kind, (_, each) in _PARTS.items()} | {"article": _PLAIN_ARTICLE}
    for kind, each in names.items():
        for name in each:
            kinds.setdefault(_slot(f"of:{name}", PATH_SLOTS), set()).add(kind)
    # Names and tags share slots: the tag counts, and no name that an element of every page hides.
    kinds |= {_slot(tag, PATH_SLOTS): {kind} for tag, kind in _PLAIN_TAGS.items()}
    for tag in (_P_ENDERS | _SCOPE | {"html", "li", "tr", "td", "th", "dt", "dd"}) - _PLAIN_TAGS.keys():
        kinds.pop(_slot(tag, PATH_SLOTS), None)
        kinds.pop(_slot(f"leaf:{tag}", PATH_SLOTS), None)
    found: dict[str, list[str]] = {}
    for block in (b for page in pages for b in page):
        hit = set().union(*(kinds[x] for x in block.path if x in kinds))
        if len(hit) == 1:
            found.setdefault(hit.pop(), []).extend(block.text.split())
    return found


def sample_layout(
    rng: np.random.Generator,
    words: list[str],
    parts: dict[str, list[str]] | None = None,
    bare: bool = False,
) -> tuple[str, list[bool]]:
    """A page of random layout around the words, and for each of its blocks whether it is article.

    Where ``parts`` holds words of a part, half of its blocks are made of those.  The
    article of a ``bare`` page stands in elements without a name.
    """
    page: list[str] = []
    labels: list[bool] = []
    part = "article"

    def some(low: int, high: int) -> str:
        own = (parts or {}).get(part)
        pool = own if own and rng.random() < 0.5 else words
        size = int(rng.integers(low, high + 1))
        at = int(rng.integers(0, max(1, len(pool) - size)))
        return html.escape(" ".join(pool[at : at + size]), quote=False) or "x"

    def pick(values: tuple[str, ...]) -> str:
        return values[int(rng.integers(len(values)))]

    def opened(tags: tuple[str, ...], names: tuple[str, ...], plain: float) -> str:
        tag = pick(tags)
        if rng.random() < plain and tag not in ("div", "ul", "ol", "section", "ins"):
            page.append(f"<{tag}>")
            return tag
        extra = rng.random()
        name = pick(names)
        if extra < 0.25:
            name = f"{pick(_WRAPPERS)}-{name}"
        elif extra < 0.5:
            name = f"{name}-{pick(_WRAPPERS)}"
        elif extra < 0.6:
            name = f"{name} {pick(_WRAPPERS)}"
        key = "id" if rng.random() < 0.25 else "class"
        page.append(f'<{tag} {key}="{name}">')
        return tag

    def leaf(tag: str, text: str, label: bool, unclosed: bool = False) -> None:
        shown = text
        style = rng.random()
        if style < 0.15:
            shown = f"<b>{text}</b>"
        elif style < 0.25:
            shown = f'<a href="#">{text}</a>'
        elif style < 0.3:
            shown = f"<b>{text}<br>"
        page.append(f"<{tag}>{shown}" + ("" if unclosed else f"</{tag}>"))
        labels.append(label)

    def aside(kind: str) -> None:
        nonlocal part
        tags, names = _PARTS[kind]
        tag = opened(tags, names, 0.5)
        part = kind
        long = kind in ("comments", "sidebar", "notice") and rng.random() < 0.6
        inner = int(rng.integers(1, 7))
        shape = rng.random()
        if tag in ("ul", "ol") or (shape < 0.4 and kind in ("menu", "sidebar", "footer", "share", "comments")):
            if tag not in ("ul", "ol"):
                page.append("<ul>")
            for _ in range(inner):
                text = some(1, 40 if long else 4)
                page.append(f'<li><a href="/x">{text}</a></li>' if not long else f"<li>{text}</li>")
                labels.append(False)
            if tag not in ("ul", "ol"):
                page.append("</ul>")
        elif shape < 0.6:
            page.append(some(1, 60 if long else 12))
            labels.append(False)
        else:
            for k in range(inner):
                leaf("h3" if k == 0 and rng.random() < 0.5 else pick(("p", "p", "div")), some(1, 60 if long else 10), False)
        if kind == "form":
            page.append('<input type="text" name="q"><button>' + some(1, 2) + "</button>")
            labels.append(False)
        page.append(f"</{tag}>")
        part = "article"

    def article() -> None:
        if bare:
            tag = pick(("div", "div", "section"))
            page.append(f"<{tag}>")
        else:
            tag = opened(*_ARTICLE, 0.7)
        if rng.random() < 0.7:
            leaf(pick(("h1", "h1", "h2")), some(2, 12), True)
        unclosed = rng.random() < 0.2
        for _ in range(int(rng.integers(1, int(rng.choice((8, 16, 50)))))):
            kind = rng.random()
            if kind < 0.8:
                leaf("p", some(1, int(rng.choice((4, 12, 90)))), True, unclosed)
            elif kind < 0.82:
                text = some(1, 20)
                for _ in range(int(rng.integers(2, 20))):
                    leaf("p", text, True, unclosed)
            elif kind < 0.86:
                leaf(pick(("h2", "h3")), some(1, 8), True)
            elif kind < 0.91:
                page.append(pick(("<ul>", "<ol>")))
                for _ in range(int(rng.integers(1, 5))):
                    leaf("li", some(1, 20), True)
                page.append("</ul>" if "<ul>" in page[-6:] else "</ol>")
            elif kind < 0.96:
                leaf(pick(("blockquote", "pre", "div")), some(3, 60), True)
            else:
                aside(pick(("advert", "share", "sidebar", "form", "notice")))
        page.append(f"</{tag}>")

    page.append("<html><head><title>" + some(2, 8) + "</title><style>p{margin:0}</style></head><body>")
    wraps = int(rng.integers(0, 3))
    for _ in range(wraps):
        page.append(f'<div class="{pick(_WRAPPERS)}">')
    for kind in ("header", "menu", "notice", "advert", "form", "share"):
        if rng.random() < (0.75 if kind == "menu" else 0.4):
            aside(kind)
    if rng.random() < 0.2:
        aside("sidebar")
    article()
    for kind in ("share", "advert", "sidebar", "comments", "form", "notice"):
        if rng.random() < (0.55 if kind == "comments" else 0.35):
            aside(kind)
    page.append("</div>" * wraps)
    if rng.random() < 0.85:
        aside("footer")
    page.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(page), labels


Weights = dict[str, np.ndarray]


def start_weights(seed: int = 29) -> Weights:
    rng = np.random.default_rng(seed)
    width = 2 * DIM + MEASURES
    p = {
        "path": rng.normal(0, 0.1, (PATH_SLOTS, DIM)),
        "word": rng.normal(0, 0.02, (WORD_SLOTS, DIM)),
        "o": rng.normal(0, 0.1, 2 * HIDDEN + width),
        "o0": np.zeros(1),
    }
    for side in ("f", "b"):
        p[f"x{side}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
        p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p[f"z{side}"] = np.zeros(4 * HIDDEN)
        p[f"z{side}"][HIDDEN : 2 * HIDDEN] = 1
    return p


def _shares(sizes: np.ndarray) -> np.ndarray:
    """What one of so many slots weighs: sums grow by the root up to 16 slots, and no further."""
    return 1 / np.maximum(np.sqrt(sizes), sizes / 4)


def _ragged_mean(table: np.ndarray, rows: list) -> np.ndarray:
    out = np.zeros((len(rows), table.shape[1]))
    sizes = np.array([len(r) for r in rows])
    # Long rows are counted per slot, so that no vector per word is ever laid out.
    for i in np.flatnonzero(sizes > len(table) // 4):
        out[i] = np.bincount(rows[i], minlength=len(table)) @ table * _shares(sizes[i])
    few = np.flatnonzero((sizes > 0) & (sizes <= len(table) // 4))
    for at in range(0, len(few), _FEW):
        some = few[at : at + _FEW]
        flat = np.concatenate([np.asarray(rows[i], np.int64) for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(table[flat], starts) * _shares(sizes[some])[:, None]
    return out


def _words(block: Block, known: dict[str, int]) -> np.ndarray:
    """Slots of all words of a block, in any letter case."""
    words = block.text.lower().split()
    if len(known) > CACHE_WORDS:
        known.clear()
    for word in set(words).difference(known):
        known[word] = _slot(word, WORD_SLOTS)
    return np.fromiter(map(known.__getitem__, words), np.int16, len(words))


def _measures(page: list[Block]) -> np.ndarray:
    n = len(page)
    size = np.array([len(b.text) for b in page], np.float64)
    return np.stack(
        (
            np.log1p(size) / 5,
            np.array([b.link_share for b in page]),
            np.arange(n) / max(1, n - 1),
            np.array([b.text[-1] in ".!?:" for b in page], np.float64),
            np.log1p(size.sum() - size) / 10,
        ),
        1,
    )


def _inputs(p: Weights, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Padded inputs (time, page, width), mask, and the slots used."""
    paths = [b.path for page in pages for b in page]
    known: dict[str, int] = {}
    words = [_words(b, known) for page in pages for b in page]
    flat = np.concatenate(
        (
            _ragged_mean(p["path"], paths),
            _ragged_mean(p["word"], words),
            np.concatenate([_measures(page) for page in pages]),
        ),
        1,
    )
    sizes = np.array([len(page) for page in pages])
    x = np.zeros((sizes.max(), len(pages), flat.shape[1]))
    mask = np.arange(sizes.max())[:, None] < sizes[None, :]
    page_of = np.repeat(np.arange(len(pages)), sizes)
    time_of = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[time_of, page_of] = flat
    return x, mask, (time_of, page_of), [paths, words]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(
    p: Weights, side: str, x: np.ndarray, mask: np.ndarray, taped: bool = True
) -> tuple[np.ndarray, list]:
    """Hidden states in time order, and all steps if ``taped``; padded steps keep the state."""
    steps, many, _ = x.shape
    into = x @ p[f"x{side}"] + p[f"z{side}"]
    h, c = np.zeros((many, HIDDEN)), np.zeros((many, HIDDEN))
    out, tape = np.zeros((steps, many, HIDDEN)), []
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        a = into[t] + h @ p[f"h{side}"]
        i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        if taped:
            tape.append((t, h, c, i, f, o, g, new, m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[t] = h
    return out, tape


def _lstm_back(p: Weights, side: str, x: np.ndarray, tape: list, d_out: np.ndarray, grads: Weights) -> np.ndarray:
    dx = np.zeros_like(x)
    dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
    for t, h, c, i, f, o, g, new, m in reversed(tape):
        dh = dh + d_out[t]
        s = np.tanh(new)
        do, dnew = dh * s * m, (dh * o * (1 - s * s) + dc) * m
        da = np.concatenate(
            (dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)), 1
        )
        grads[f"x{side}"] += x[t].T @ da
        grads[f"h{side}"] += h.T @ da
        grads[f"z{side}"] += da.sum(0)
        dx[t] = da @ p[f"x{side}"].T
        dh = np.where(m, da @ p[f"h{side}"].T, dh)
        dc = np.where(m, dnew * f, dc)
    return dx


def _logits(p: Weights, pages: list[list[Block]], taped: bool = True) -> tuple:
    x, mask, at, slots = _inputs(p, pages)
    forth, tape_f = _lstm(p, "f", x, mask, taped)
    back, tape_b = _lstm(p, "b", x, mask, taped)
    z = np.concatenate((forth, back, x), 2)[at]
    return z @ p["o"] + p["o0"][0], (x, mask, at, slots, tape_f, tape_b, z)


def _gradients(p: Weights, pages: list[list[Block]], y: np.ndarray) -> Weights:
    logit, (x, _, at, (paths, words), tape_f, tape_b, z) = _logits(p, pages)
    d = (_sigmoid(logit) - y) / len(y)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["o"], grads["o0"] = z.T @ d, np.array([d.sum()])
    dz = d[:, None] * p["o"]
    full = np.zeros((*x.shape[:2], dz.shape[1]))
    full[at] = dz
    dx = full[:, :, 2 * HIDDEN :].copy()
    dx += _lstm_back(p, "f", x, tape_f, full[:, :, :HIDDEN], grads)
    dx += _lstm_back(p, "b", x, tape_b, full[:, :, HIDDEN : 2 * HIDDEN], grads)
    flat = dx[at]
    for name, rows, low in (("path", paths, 0), ("word", words, DIM)):
        sizes = np.array([len(r) for r in rows])
        if sizes.sum():
            which = np.repeat(np.arange(len(rows)), sizes)
            slots = np.concatenate([np.asarray(r, np.int64) for r in rows if len(r)])
            value = flat[which, low : low + DIM] * _shares(sizes[which])[:, None]
            np.add.at(grads[name], slots, value)
    return grads


def train(
    texts: list[str],
    parts: dict[str, list[str]] | None = None,
    layouts: int = LAYOUTS,
    epochs: int = EPOCHS,
    seed: int = 29,
) -> Weights:
    """Adam over minibatches of composed pages; ``texts`` and ``parts`` give them their words."""
    rng = np.random.default_rng(seed)
    pool = [w for t in texts for w in t.split()] + ["text"] * 400
    reader, pages = Reader(), []
    while len(pages) < layouts:
        page, labels = sample_layout(rng, pool, parts, rng.random() < BARE)
        blocks = reader.blocks(page)
        if len(blocks) == len(labels):
            pages.append((blocks, np.array(labels, np.float64)))
    p = start_weights(seed)
    moment = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(pages)), key=lambda i: len(pages[i][0]) // 8)
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            chosen = [pages[i] for i in groups[g]]
            step += 1
            grads = _gradients(p, [b for b, _ in chosen], np.concatenate([y for _, y in chosen]))
            rate = 0.01 * (1 - epoch / epochs)
            for k, v in grads.items():
                moment[k] += 0.1 * (v - moment[k])
                square[k] += 0.01 * (v * v - square[k])
                # Layouts say more than words, which may only move slowly.
                p[k] = p[k] - (rate / WORD_RATE if k == "word" else rate) * (moment[k] / (1 - 0.9**step)) / (
                    np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8
                )
    return p


def label(p: Weights, pages: list[list[Block]]) -> list[list[float]]:
    """Probability of being article for each block; pages of similar length go together."""
    out: list[list[float]] = [[] for _ in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # Few long pages or many short ones, so that padding stays small.
        size = max(1, min(256, 16_384 // len(pages[order[at]])))
        chosen = order[at : at + size]
        while len(pages[chosen[-1]]) > 2 * len(pages[chosen[0]]) + 8:
            chosen.pop()
        at += len(chosen)
        found = _sigmoid(_logits(p, [pages[i] for i in chosen], taped=False)[0])
        for i, part in zip(chosen, np.split(found, np.cumsum([len(pages[i]) for i in chosen])[:-1])):
            out[i] = part.tolist()
    return out


def learn(pages: list[str]) -> Weights:
    """Learn from layouts composed around the texts of pages, and of the parts they name."""
    reader = Reader()
    read = [reader.blocks(x) for x in pages]
    return train([" ".join(b.text for b in page) for page in read], named_parts(read))


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Weights:
    """Learn from layouts composed around the texts of at most ``sample`` pages."""
    chosen = (
        pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
        .select(F.col("page_id").cast("long").alias("page_id"))
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(sample)
    )
    rows = (
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.substring("html", 1, SAMPLE_CHARS).alias("html"),
        )
        .join(F.broadcast(chosen.distinct()), "page_id")
        .where(F.col("html").isNotNull())
        .orderBy(F.xxhash64("page_id"), F.xxhash64("html"))
        .limit(sample)
        .collect()
    )
    return learn([r.html for r in rows])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the blocks labelled as article.

    Blocks are joined by line feeds in page order, with character references decoded and
    white space in a block made one space.  A missing or empty page, and one without
    article, has an empty text; unclosed tags and cut pages are read as far as they go;
    repeated rows give equal rows; extra columns are left out; an empty table gives none.
    """
    p = fit(pages)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 512):
                found = [reader.blocks(x) for x in batch.iloc[at : at + 512]]
                for blocks, scores in zip(found, label(p, found)):
                    parts.append("\n".join(b.text for b, s in zip(blocks, scores) if s >= 0.5))
            yield pd.Series(parts, dtype=object)

    found = pages.select("page_id", "url", main_text(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
