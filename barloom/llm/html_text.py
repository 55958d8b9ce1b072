"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of block tags from the root to it. Per path, the text
length and the punctuation of its blocks are summed and divided by their number; both ratios are smoothed
over the page's blocks and fused by their geometric mean. Names weigh the ratios: a path through what is named as
furniture (menus, forms, adverts, comments and the like) counts less, and one outside of the page's articles too.
An element that holds more text than all that is not in furniture and an article or the headline is no furniture,
whatever it is called. Paths above a threshold are content; blocks beside content in the same container
(headings, lists, tables, short paragraphs) go with it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag names of HTML by what they mean here.
UNSEEN = frozenset("script style noscript template svg math canvas iframe object embed head title audio video select datalist".split())
FURNITURE = frozenset("nav footer aside form button menu dialog fieldset input textarea label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rt rp rb".split()
)
#: Blocks of running text, which may stand at any depth below their container.
TEXTUAL = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption header hgroup address center details summary".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Start tags that end an open element of one of these names, up to a boundary.
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
#: Words of a class, id or role that name furniture, and one that does so alone only.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist
    complementary contentinfo cookie cookies consent copyright disqus discussion dropdown footer gdpr login masthead menu menus
    modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    tags toolbar topbar widget widgets alert dialog""".split()
)
ALONE = "hidden"
#: Reader comments, which may be longer than what they are about, and words that turn a name into a statement.
SPEECH = frozenset("comment comments commentlist disqus discussion replies respond".split())
STATES = frozenset("no not non without with has have is free open closed off on enabled disabled layout".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")
HEADLINES = frozenset(("article", "main", "h1"))

#: A path is content if its weighed ratio is at least this share of the mean over the page's text.
THRESHOLD = 0.35
#: Weights of what is named as furniture, of what a part of a name says so of, and of what is outside of articles
#: where those have a quarter of the text; what weighs less than the last is never content.
NAMED, HINTED, OUTSIDE, LEAST = 0.05, 0.15, 0.25, 0.08
#: Weights of the smoothing over neighbouring blocks.
KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[A-Za-z]")
#: Ends of comments, sections and declarations; where there is none they go on to the end of the page.
_ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*+)>""")
#: A tag whose quotes don't close: it ends at the next ``>``.
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>[^>]*)>")
#: Characters that are read in vain for closing quotes, in all: so many, and so many times the page.
VAIN, VAIN_TIMES = 1_000_000, 4
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_LABEL = re.compile(r"""\b(?:class|id)\s*=\s*["']?\s*([^\s"'>/]+)""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Markup:
    """The mark-up of a page, piece after piece, in time linear in the page's length."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">") + 1  # no tag begins behind the last that could end one
        self.vain = VAIN + VAIN_TIMES * len(page)

    def next(self, at: int) -> tuple[int, int, re.Match | None, str | None] | None:
        """Begin and end of the next piece from ``at`` on, and its match if it is a tag or its text if it is a CDATA section."""
        page = self.page
        while m := _OPEN.search(page, at):
            start, what = m.start(), m[0]
            if what in _ENDS:
                end = page.find(_ENDS[what], m.end())
                stop = len(page) if end < 0 else end + len(_ENDS[what])
                return start, stop, None, page[m.end() : len(page) if end < 0 else end] if what == "<![CDATA[" else None
            if start < self.last:
                tag = _TAG.match(page, start) if self.vain > 0 else None
                if tag is None:
                    self.vain -= len(page) - start
                    tag = _LOOSE.match(page, start)
                return start, tag.end(), tag, None
            at = m.end()
        return None


class Paths:
    """Paths as numbers, each with its last tag, its parent and whether it goes through an article."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.tag, self.parent, self.inside = [""], [0], [False]

    def below(self, path: int, tag: str, label: str) -> int:
        k = self.number.get((path, label))
        if k is None:
            k = self.number[path, label] = len(self.tag)
            self.tag.append(tag)
            self.parent.append(path)
            self.inside.append(self.inside[path] or tag in ("article", "main"))
        return k

    def container(self, path: int) -> int:
        """The path without the tags of running text at its end."""
        while path and self.tag[path] in TEXTUAL:
            path = self.parent[path]
        return path


@dataclass
class Piece:
    """An element that is named as furniture: the one it is in, its weight, and what its own text says against it."""

    parent: int
    weight: float
    may_hold: bool  # a form or a name, which may stand for a wrapper
    hint: bool  # a form, or a name of which it is a part
    speech: bool
    own: int = 0
    headline: bool = False


def _unseen(attrs: str) -> bool:
    if "hidden" not in attrs.lower() and "none" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def named(attrs: str, header: bool = False) -> tuple[float, bool, bool]:
    """The weight that class, id and role give, whether a name only hints at furniture, and whether it is of comments.

    ``header``: a header counts as furniture. Names that state something (``no-sidebar``, ``ad-free``) say nothing.
    """
    weight, hint, speech = 1.0, True, False
    if "=" not in attrs:
        return weight, hint, speech
    for m in _ATTR.finditer(attrs):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for one in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _WORD.findall(one)]
            if not words or words[0] in STATES or words[-1] in STATES:
                continue
            marked = [w in MARKED or header and w == "header" or one == ALONE for w in words]
            if any(marked):
                weight = min(weight, NAMED if marked[0] or marked[-1] else HINTED)
                hint = hint and not all(marked)
                speech = speech or not SPEECH.isdisjoint(words)
    return weight, hint, speech


def blocks(page: str) -> tuple[list[tuple[int, str, int]], Paths, list[Piece]]:
    """The page's blocks in order, each with its path, its text and the innermost piece of furniture around it (-1: none).

    An end tag ends all elements inside its own. White space in a block is one space; empty blocks are left out.
    """
    out: list[tuple[int, str, int]] = []
    paths, pieces = Paths(), []
    stack: list[tuple[str, bool, int, int]] = []  # tag, seen below, piece, path
    open_tags: Counter = Counter()
    nested = 0  # inline elements of its name inside an inline element on the stack
    seen, piece, path = True, -1, 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if seen and (text := " ".join("".join(parts).split())):
                out.append((path, text, piece))
            parts.clear()

    def refresh() -> None:
        nonlocal seen, piece, path
        _, seen, piece, path = stack[-1] if stack else ("", True, -1, 0)

    def push(tag: str, shown: bool, furniture: Piece | None, label: str) -> None:
        k = piece
        if furniture:
            k = len(pieces)
            pieces.append(furniture)
        stack.append((tag, shown, k, paths.below(path, tag, label)))
        open_tags[tag] += 1
        refresh()

    def close(k: int) -> None:
        flush()
        open_tags.subtract(x[0] for x in stack[k:])
        del stack[k:]
        refresh()

    def find(names: tuple[str, ...], boundary: tuple[str, ...]) -> int:
        found = -1
        if any(open_tags[x] for x in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in boundary:
                    break
                if stack[k][0] in names:
                    found = k
        return found

    def text(raw: str) -> None:
        parts.append(html.unescape(raw) if "&" in raw else raw)

    at, n, markup = 0, len(page), Markup(page)
    while at < n:
        found = markup.next(at)
        if found is None:
            text(page[at:])
            break
        start, end, m, cdata = found
        if start > at:
            text(page[at:start])
        at = end
        if cdata is not None:
            parts.append(cdata)
        if m is None:
            continue
        name, attrs = m["name"].lower(), m["attrs"] or ""
        star = f"{name}*"
        if m["end"]:
            if name in INLINE:
                if stack and stack[-1][0] == star:
                    if nested:
                        nested -= 1
                    else:
                        close(len(stack) - 1)
            elif open_tags[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else n
            continue
        if name in VOID:
            if name in ("br", "img"):
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in INLINE:
            if stack and stack[-1][0] == star:
                nested += 1
            elif attrs and not attrs.endswith("/"):
                hidden, (weight, _, speech) = _unseen(attrs), named(attrs)
                if hidden or name == "span" and weight == NAMED:
                    flush()
                    nested = 0
                    push(star, seen and not hidden, Piece(piece, weight, False, False, speech) if weight < 1 else None, name)
            continue
        if name in ENDS_P and (k := find(("p",), ("article", "section", "div", "td", "th", "li", "button", "blockquote"))) >= 0:
            close(k)
        if name in ENDS_LIKE and (k := find(*ENDS_LIKE[name])) >= 0:
            close(k)
        flush()
        outside = not (open_tags["article"] or open_tags["main"])
        weight, hint, speech = (1.0, True, False) if not attrs or name in ("body", "html") else named(attrs, outside)
        furniture = None
        if name in FURNITURE or name == "header" and outside:
            furniture = Piece(piece, NAMED, name == "form", name == "form", speech)
        elif weight < 1:
            furniture = Piece(piece, weight, True, hint, speech)
        label = _LABEL.search(attrs) if name in ("div", "section") and attrs else None
        push(name, seen and name not in UNSEEN and not (attrs and _unseen(attrs)), furniture, f"{name}.{label[1]}" if label else name)
        if name in HEADLINES and piece >= 0:
            pieces[piece].headline = True
    flush()
    return out, paths, pieces


def piece_weights(found: list[tuple[int, str, int]], paths: Paths, pieces: list[Piece]) -> list[float]:
    """Weights of what is in each piece of furniture. Pieces that hold the article are none: see the module's text."""
    free = sum(len(text) for _, text, k in found if k < 0)
    elsewhere = any(k < 0 and paths.inside[path] for path, _, k in found)
    for _, text, k in found:
        if k >= 0:
            pieces[k].own += len(text)
    for p in reversed(pieces):
        if p.may_hold and p.own > free and (p.headline and not (p.speech and elsewhere) or p.hint and not p.speech and not elsewhere):
            p.weight = 1.0
            if p.parent >= 0:
                pieces[p.parent].own += p.own
                pieces[p.parent].headline |= p.headline
            else:
                free += p.own
                elsewhere |= p.headline
    weights: list[float] = []
    for p in pieces:
        weights.append(p.weight * (weights[p.parent] if p.parent >= 0 else 1.0))
    return weights


def path_scores(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused ratio of each block's path."""
    _, of = np.unique(paths, return_inverse=True)
    count = np.bincount(of)
    n = len(of)
    norm = np.convolve(np.ones(n), KERNEL)[2 : 2 + n]
    fused = np.ones(n)
    for x in (lengths, marks + 1):
        fused *= np.convolve((np.bincount(of, x) / count)[of], KERNEL)[2 : 2 + n] / norm
    return (np.bincount(of, np.sqrt(fused)) / count)[of]


def main_text(page: str) -> str:
    """Content blocks of a page, joined by line ends."""
    found, paths, pieces = blocks(page)
    if not found:
        return ""
    by_piece = piece_weights(found, paths, pieces)
    of = np.array([b[0] for b in found])
    lengths = np.array([len(b[1]) for b in found], dtype=float)
    marks = np.array([sum(map(b[1].count, PUNCTUATION)) for b in found], dtype=float)
    weights = np.array([by_piece[b[2]] if b[2] >= 0 else 1.0 for b in found])
    inside = np.array([paths.inside[p] for p in of]) & (weights > LEAST)
    if lengths[inside].sum() * 4 > lengths[weights > LEAST].sum():
        weights = np.where(inside, weights, weights * OUTSIDE)
    usable = weights > LEAST
    if not usable.any():
        return ""
    scores = path_scores(of, lengths, marks) * weights
    chosen = usable & (scores >= THRESHOLD * np.average(scores, weights=lengths * weights))
    homes: dict[int, float] = {}
    for p, w in zip(of[chosen].tolist(), weights[chosen].tolist()):
        home = paths.container(p)
        homes[home] = max(w, homes.get(home, 0.0))
    return "\n".join(b[1] for b, c, w in zip(found, chosen, weights) if c or w >= homes.get(paths.container(b[0]), 2.0))


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p or "") for p in pages], dtype=object)

    return of(page)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of ``page``, in place of ``page``.

    Null and empty pages, and those without content, have an empty text. Rows are worked on one by one, so
    repeated rows and null keys need no care. A column named ``text`` before is replaced; others stay as they are.
    Pages of any length and depth are read whole, in one pass. An empty table gives no rows.
    """
    return pages.withColumn(text, extracted(F.col(page))).drop(*({page} - {text}))
