"""Main text of web pages by a conditional random field (operator 5).

A page becomes the sequence of its leaf blocks: runs of text between block
boundaries, each with the elements around it.  Blocks are described by their
ancestors' tags and class or id words and by their text; a linear-chain CRF,
fitted on labelled pages, gives each block the label content or other, and
Viterbi finds the best sequence.  The text of the content blocks, joined by
line feeds, is the result.

The labelled pages are drawn from layouts in which every part's role is known
(``labelled_pages``); class words are dropped at random so that tags, text and
neighbours must tell as well.  Weights are a few kilobytes; extraction is a map
over pages without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element roles of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover "
                   "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr "
                   "munder munderover none semantics".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                     "nav ol p pre section table ul li dt dd tr td th".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SCOPES = frozenset("ul ol dl table select article section div body".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[<>]|=\s*+([\"']?)")  # what ends a tag, or begins a value
_VALUE = re.compile(r"[^\s>]*+")
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")

# Class and id words by what they tell (fixed values).
HINTS = {
    "content": "article content post entry story text body main hentry articlebody prose",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc pager pagination tabs skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer copyright colophon legal bottom",
    "side": "sidebar side aside widget rail related recommended popular trending tags",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad",
    "notice": "notice cookie cookies consent alert warning popup modal newsletter subscribe paywall gdpr",
    "comment": "comment comments reply replies disqus discussion respond reader",
    "form": "form search login signup contact field",
    "share": "share sharing social meta byline author date",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
TAGS = ("article main section div nav header footer aside form ul ol li table td p h1 h2 h3 h4 blockquote pre "
        "figure figcaption address dl button").split()


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]    # elements around the block, outermost first
    hints: tuple[str, ...]   # hint of each element, or ""
    linked: int              # characters inside <a>


def _hint(attrs: str) -> str:
    found = [w for m in _ATTRIBUTE.finditer(attrs) for w in _WORD.findall(m.group(2).lower())]
    return next((_HINT_OF[w] for w in found if w in _HINT_OF), "")


def clean(text: str) -> str:
    """Character references decoded, white space made one space, trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int, bool]:
    """(end of the attributes, end of the tag, whether a value without quotes goes up to
    the end: a slash there is the value's) from the end of its name on.  A quote counts
    where a value begins; one that is never closed ends with the tag.  A tag without
    its ``>`` ends at the next ``<``, or with the page."""
    value = -1
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start(), m.end(), value == m.start()
        if m[0] == "<":
            return m.start(), m.start(), value == m.start()
        at = m.end()
        if m[1]:
            if last[m[1]] >= at:
                at = page.index(m[1], at) + 1
            elif last[">"] >= at:
                at = page.index(">", at)
                return at, at + 1, False
            else:
                break
        else:
            at = value = _VALUE.match(page, at).end()
    return len(page), len(page), False


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(begin, end, raw element, slash of an end tag, tag, attributes) of the markup, in one
    walk over the page whatever it holds: every character is looked at a fixed
    number of times.  Comments and the like have no tag; a raw element is one token
    up to its end tag, or to the end of the page."""
    at, last = 0, {c: page.rfind(c) for c in "\"'>"}
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        raw = slash = tag = attributes = ""
        if page.startswith("!--", at):
            end = page.find("-->", begin + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("!", "?"), at):
            if last[">"] < at:
                continue
            end = page.index(">", at) + 1
        elif m := _NAME.match(page, at):
            slash, tag = m[1], m[2].lower()
            stop, end, of_value = _tag_end(page, m.end(), last)
            attributes = page[m.end(): stop]
            if of_value and attributes.endswith("/"):
                attributes += " "  # the tag has no slash of its own
            if tag in _RAW_END and not slash:
                if tag != "svg" or not attributes.endswith("/"):
                    closing = _RAW_END[tag].search(page, end)
                    end = closing.end() if closing else len(page)
                raw, tag = tag, ""
        else:
            continue
        yield begin, end, raw, slash, tag, attributes
        at = end


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order.  Comments, scripts, styles, titles and
    the like give none; unclosed elements end where HTML lets them."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []  # block elements only
    pieces: list[str] = []
    around: tuple[tuple[str, ...], tuple[str, ...]] | None = None  # of the stack as it stands
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked, around
        if pieces:
            text = clean("".join(pieces))
            if text:
                if around is None:
                    around = tuple(t for t, _ in stack), tuple(h for _, h in stack)
                blocks.append(Block(text, *around, linked))
            pieces.clear()
        linked, around = 0, None

    def pop_to(names: tuple[str, ...], scopes: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    def leave_head() -> None:
        """</head> may be left out: text and the first start tag of the body end the head."""
        if stack and stack[-1][0] == "head":
            flush()
            stack.pop()

    at = 0
    for begin, end, raw, close, tag, attrs in tokens(page):
        if begin > at:
            if not page[at:begin].isspace():
                leave_head()
            pieces.append(page[at:begin])
            if in_link:
                linked += begin - at
        at = end
        if not tag:
            if raw and raw not in ("svg", "select"):
                pieces.append(" " if pieces else "")
            continue
        if not close and tag not in IN_HEAD:
            leave_head()
        if tag in INLINE:
            if tag == "br":
                pieces.append("\n")
            elif tag == "a":
                in_link = 0 if close else 1
            continue
        flush()
        in_link = 0
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if tag in CLOSES_P:
                pop_to(("p",), SCOPES)
            if tag in ITEMS:
                pop_to(ITEMS[tag], SCOPES - {"div"} if tag != "li" else SCOPES)
            if not attrs.endswith("/") or tag in ("p", "div"):
                stack.append((tag, _hint(attrs) if "=" in attrs else ""))
    if at < len(page):
        rest = page[at:]
        if not rest.isspace():
            leave_head()
        pieces.append(rest)
    flush()
    return [b for b in blocks if "head" not in b.tags]


# -- features

_NAMES: list[str] = (["bias", "first", "last", "repeat"] + [f"in:{t}" for t in TAGS] + [f"own:{t}" for t in TAGS]
                     + [f"hint:{h}" for h in HINTS] + [f"near:{h}" for h in HINTS]
                     + [f"words:{i}" for i in range(6)] + [f"links:{i}" for i in range(4)]
                     + ["sentence", "comma", "copyright", "digits", "upper"])
FEATURES = {n: i for i, n in enumerate(_NAMES)}


_around_cache: dict[tuple, list[int]] = {}


def _around(tags: tuple[str, ...], hints: tuple[str, ...], with_hints: bool) -> list[int]:
    """Indices of the features that a block's elements give."""
    key = tags, hints, with_hints
    if key not in _around_cache:
        if len(_around_cache) > 50_000:
            _around_cache.clear()
        on = {"bias", *(f"in:{t}" for t in tags), *(f"own:{t}" for t in tags[-1:])}
        if with_hints:
            told = [h for h in hints if h]
            on.update(f"hint:{h}" for h in told)
            on.update(f"near:{h}" for h in told[-1:])
        _around_cache[key] = [FEATURES[f] for f in on if f in FEATURES]
    return _around_cache[key]


def features(blocks: list[Block], with_hints: bool = True) -> list[list[int]]:
    """Indices of each block's features (all are 0 or 1)."""
    out, seen, at = [], set(), FEATURES
    for i, b in enumerate(blocks):
        text = b.text
        on = _around(b.tags, b.hints, with_hints).copy()
        if i == 0:
            on.append(at["first"])
        if i == len(blocks) - 1:
            on.append(at["last"])
        if text in seen:
            on.append(at["repeat"])
        seen.add(text)
        on.append(at["words:0"] + bisect_left((2, 5, 12, 30, 80), text.count(" ") + 1))
        on.append(at["links:0"] + bisect_left((0.0001, 0.3, 0.7), b.linked / len(text)))
        if text[-1] in ".!?…\"”»":
            on.append(at["sentence"])
        if ", " in text:
            on.append(at["comma"])
        if "©" in text or "all rights reserved" in text.lower():
            on.append(at["copyright"])
        if _DIGIT.search(text):
            on.append(at["digits"])
        if text.isupper():
            on.append(at["upper"])
        out.append(on)
    return out


# -- labelled pages

def labelled_pages(pages: int = 240, seed: int = 3) -> list[tuple[list[Block], np.ndarray, bool]]:
    """(blocks, labels, whether class words are to be seen) of drawn pages.  A
    label's mark stands in the drawn text and is taken out of the blocks."""
    rng = np.random.default_rng(seed)
    syllables = "ta re lo mi sen dor ka vel ri no pa chi mon ser ul an te gra bi os".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(low, high + 1)))

    def sentence(low: int = 4, high: int = 18) -> str:
        text = words(low, high).capitalize()
        return text.replace(" ", ", ", 1) + "." if rng.random() < 0.4 else text + "."

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.integers(1, 7)))

    def links(n: int, item: str = "li") -> str:
        return "".join(f"<{item}>{mark(0)}<a href='/x'>{words(1, 3)}</a></{item}>" for _ in range(n))

    def mark(label: int) -> str:
        return "\ue001" if label else "\ue000"

    def wrap(kinds: list[str], inner: str) -> str:
        opening = kinds[rng.integers(len(kinds))]
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def article() -> str:
        parts = [f"<h1>{mark(1)}{words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                parts.append(f"<p>{mark(1)}{prose()}</p>")
            elif kind < 0.8:
                parts.append(f"<p>{mark(1)}{words(1, 3)}</p>")
            elif kind < 0.86:
                parts.append(f"<h2>{mark(1)}{words(1, 6)}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li>{mark(1)}{sentence(2, 9)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.96:
                parts.append(f"<blockquote><p>{mark(1)}{prose()}</p></blockquote>")
            else:
                parts.append(f"<p>{mark(1)}{words(3, 8)} 20{rng.integers(10, 30)}. All rights reserved.</p>")
            if rng.random() < 0.08:
                parts.append(wrap(["div class='ad'", "aside", "div class='share'", "div class='newsletter'"],
                                  f"<p>{mark(0)}{sentence()}</p>"))
        return wrap(["article", "article", "article", "main", "div class='content'", "div class='post-body'",
                     "div id='main'", "div", "section class='entry'"], "".join(parts))

    def comments() -> str:
        return wrap(["section class='comments'", "div id='comments'", "ol class='replies'"], "".join(
            wrap(["article", "div class='comment'", "li"], f"<p>{mark(0)}{prose()}</p>") for _ in range(rng.integers(1, 4))))

    def boiler(kind: str) -> str:
        if kind == "nav":
            return wrap(["nav", "div class='menu'", "nav class='breadcrumbs'"], f"<ul>{links(rng.integers(2, 8))}</ul>")
        if kind == "header":
            return wrap(["header", "div class='header'", "div id='masthead'"], f"<p>{mark(0)}{words(1, 5)}</p>")
        if kind == "footer":
            return wrap(["footer", "footer", "div class='footer'"], mark(0) + rng.choice(
                [f"&copy; {words(1, 4)} &middot; {sentence()}", prose(), f"<p>{words(2, 6)}</p>"]))
        if kind == "aside":
            return wrap(["aside", "div class='sidebar'", "div class='related'"], f"<h3>{mark(0)}{words(1, 3)}</h3>" + rng.choice(
                [f"<ul>{links(3)}</ul>", f"<p>{mark(0)}{prose()}</p>"]))
        if kind == "ad":
            return wrap(["div class='ad'", "div class='advert'", "div class='sponsored'", "aside class='promo'"],
                        mark(0) + rng.choice([sentence(), prose()]))
        if kind == "notice":
            return wrap(["div class='cookie-notice'", "div class='alert'", "div role='alert' class='notice'"],
                        f"<p>{mark(0)}{sentence()}</p><button>{mark(0)}{words(1, 2)}</button>")
        return wrap(["form", "form class='search'"], f"<label>{mark(0)}{words(1, 4)}</label><input><button>{mark(0)}{words(1, 2)}</button>")

    out = []
    for _ in range(pages):
        much = rng.choice([0.0, 0.3, 0.6])  # some pages have nothing around the article
        before = "".join(boiler(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < much)
        after = "".join(boiler(k) for k in ("aside", "ad", "form", "footer") if rng.random() < much)
        middle = article() + (comments() if rng.random() < 0.35 else "")
        blocks = leaf_blocks(f"<html><body>{before}{middle}{after}</body></html>")
        labels = np.array([int("\ue001" in b.text) for b in blocks], np.int64)
        for b in blocks:
            b.text = re.sub("[\ue000\ue001]", "", b.text).strip() or "x"
        out.append((blocks, labels, rng.random() < 0.8))
    return out


# -- the random field

@dataclass
class Field:
    state: np.ndarray   # (features, 2)
    move: np.ndarray    # (2, 2): from, to
    begin: np.ndarray   # (2,)

    def scores(self, on: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for x in on for f in x), np.int64)
        sizes = np.fromiter(map(len, on), np.int64, len(on))
        return np.add.reduceat(self.state[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)

    def best(self, on: list[list[int]]) -> list[int]:
        """Viterbi: the most probable labels."""
        if not on:
            return []
        rows = self.scores(on).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.begin[0] + rows[0][0], self.begin[1] + rows[0][1]
        back = []
        for x, y in rows[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _expected(field: Field, on: list[list[int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """log Z, label marginals and summed pair marginals by forward-backward."""
    s = field.scores(on)
    n = len(s)
    forward, backward = np.empty((n, 2)), np.zeros((n, 2))
    forward[0] = field.begin + s[0]
    for i in range(1, n):
        forward[i] = np.logaddexp(*(forward[i - 1][:, None] + field.move)) + s[i]
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp(*(field.move + s[i + 1] + backward[i + 1]).T)
    log_z = float(np.logaddexp(*forward[-1]))
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(forward[:-1, :, None] + field.move + (s[1:] + backward[1:])[:, None, :] - log_z).sum(axis=0)
    return log_z, np.exp(forward + backward - log_z), pairs


def fit(data: list[tuple[list[Block], np.ndarray, bool]], rounds: int = 12, rate: float = 0.4,
        ridge: float = 0.02, seed: int = 1) -> Field:
    """Maximum conditional likelihood by Adagrad on one page at a time."""
    field = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    seen = [np.full_like(x, 1e-3) for x in (field.state, field.move, field.begin)]
    rng = np.random.default_rng(seed)
    pages = [(features(blocks, hints), labels) for blocks, labels, hints in data if blocks]
    for _ in range(rounds):
        for i in rng.permutation(len(pages)):
            on, labels = pages[i]
            _, marginal, pairs = _expected(field, on)
            truth = np.eye(2)[labels]
            gap = truth - marginal
            g_state = np.zeros_like(field.state)
            np.add.at(g_state, np.fromiter((f for x in on for f in x), np.int64), np.repeat(gap, [len(x) for x in on], axis=0))
            g_move = np.einsum("ia,ib->ab", truth[:-1], truth[1:]) - pairs
            for x, g, m in zip((field.state, field.move, field.begin), (g_state, g_move, gap[0]), seen):
                g = g - ridge * x / len(pages)
                m += g * g
                x += rate * g / np.sqrt(m)
    return field


_fitted: dict[tuple[int, int], Field] = {}


def fitted(pages: int = 240, seed: int = 3) -> Field:
    if (pages, seed) not in _fitted:
        _fitted[pages, seed] = fit(labelled_pages(pages, seed))
    return _fitted[pages, seed]


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, field.best(features(blocks))) if label)


def extract_text(pages: DataFrame, field: Field | None = None, html_column: str = "html",
                 out: str = "main_text") -> DataFrame:
    """pages plus the main text of each page (column ``out``, which must be free).
    Null or empty html, and pages without a content block, give an empty text."""
    if out in pages.columns:
        raise ValueError(f"column {out} exists; name another")
    field = field or fitted()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p, field) if p else "" for p in column.to_pylist()], pa.string())

    return pages.withColumn(out, run(F.col(html_column)))
