"""Main text of web pages by tag-path ratios.

A page is read once into text nodes with their root-to-leaf tag paths. Of each path, the mean length and punctuation of its nodes
(links count in the article only) are fused, smoothed along the page, averaged over the path and held against a threshold: the
nodes of the paths that pass are content, and the innermost container of them all is the article. A path that lies in it passes a
second, lower threshold too, so that headings, short items and cells come along.

What an element says of itself is a prior on its paths' scores: nodes of menus, forms, notices and the like (by element, or by the
words of class, id or role) count ``NOISE_PRIOR``, those of an article or main element ``ARTICLE_PRIOR`` times. The ratios decide.

Defined results: null, empty and text-less pages, and pages without a path that passes, give an empty text; an unclosed element
ends with its parent; rows that repeat a page_id are read each; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = frozenset("script style noscript template iframe svg math canvas object audio video select textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset datalist head".split())
PLAIN = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td html".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup sidebar widget widgets related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar header masthead footer comment comments disqus replies respond pagination pager login search navigationbar contentinfo complementary".split()
)
LAYOUT, ENTRY, OWN_HEAD = frozenset("has with no without".split()), frozenset("entry post article content story page".split()), frozenset("header masthead banner".split())
#: Priors on a path's score; longer or more punctuated nodes than these count as such; thresholds: least score, share of the best
#: score that makes content, share that suffices inside the article.
NOISE_PRIOR, ARTICLE_PRIOR, MOST_LENGTH, MOST_MARKS, LEAST_SCORE, CONTENT_SHARE, INNER_SHARE = 0.002, 4.0, 300, 6, 1.0, 0.5, 0.02
#: An unquoted value takes the slash after it, so it ends no tag.
_VALUE = re.compile(r"""=\s*[^\s"'>]+\Z""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")


def _noise_words(name: str) -> set[str]:
    """Words of a class, id or role that speak of noise; ``has-sidebar`` tells of a layout, ``entry-header`` of the article's own head."""
    words = re.split(r"[^a-z0-9]+", name)
    if len(words) > 1 and words[0] in LAYOUT:
        return set()
    return NOISE.intersection(words) - (OWN_HEAD if words[0] in ENTRY else set())


def _noise(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in PLAIN:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            found = set().union(*map(_noise_words, value.split()))
            if found and (tag != "article" or found & {"comment", "comments", "related", "ad", "sponsored"}):
                return True
    return False


class Block(NamedTuple):
    """A text node: its text, tag path, block elements around it (by number), characters in links, and what its elements say."""

    text: str
    path: str
    around: tuple[int, ...]
    linked: int
    noise: bool
    article: bool


class _Page:
    """Blocks of a page in order."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.names: list[str] = []  # of the elements, by number
        self.stack: list[tuple[str, int, bool]] = [("", -1, False)]
        self.buffer: list[str] = []
        self.aside: list[str] = []  # text of noisy inline elements, kept out of the paragraph around them
        self.linked = 0
        lower, at = None, 0
        for m in iter(lambda: _TOKEN.search(page, at), None):
            self.text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            elif tag in ("svg", "math") and (attrs := m[3] or m[6] or "").endswith("/") and not _VALUE.search(attrs):
                continue  # empty: elements of other languages may close themselves
            elif tag in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
                end = end if end >= 0 else (found.start() if (found := re.compile(f"</{tag}", re.I).search(page, at)) else len(page))
                close = page.find(">", end)
                at = close + 1 if close >= 0 else len(page)
            else:
                self.open(tag, m[3] or m[6] or "")
        self.text(page[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if not raw:
            return
        if self.stack[-1][2] and not self.noisy():
            self.aside.append(raw)
            return
        self.buffer.append(raw)
        if any(s[0] == "a" for s in self.stack[-3:]):
            self.linked += len(raw.strip())

    def noisy(self) -> bool:
        """Whether the innermost block element is noise itself."""
        return next((s[2] for s in reversed(self.stack) if s[0] not in INLINE), False)

    def flush(self) -> None:
        own = [s for s in self.stack[1:] if s[0] not in INLINE]
        around, article = tuple(s[1] for s in own), any(s[0] in ("article", "main") for s in own)
        for parts, linked, noise in ((self.buffer, self.linked, self.noisy()), (self.aside, 0, True)):
            text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            if text:
                self.blocks.append(Block(text, "/".join(s[0] for s in own) + "!" * noise, around, linked, noise, article))
        self.buffer, self.aside, self.linked = [], [], 0

    def open(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        noise = _noise(tag, attrs, any(s[0] in ("article", "main") for s in self.stack))
        if tag not in INLINE:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or tag[0] == "h" and tag[1:].isdigit():
                self.imply(tag)
        elif noise and self.buffer:
            self.buffer.append(" ")
        if attrs.endswith("/") and tag not in INLINE and tag not in CONTAINERS:
            return
        self.names.append(tag)
        self.stack.append((tag, len(self.names) - 1, noise or self.stack[-1][2]))

    def imply(self, tag: str) -> None:
        """An open paragraph or item of the same kind ends where the next begins."""
        stops = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ())
        ends = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,) if stops else ("p",))
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name in ends:
                del self.stack[k:]
                return
            if name in stops or name in CONTAINERS or name in DROPPED:
                return

    def close(self, tag: str) -> None:
        if tag in VOID:
            self.open(tag, "")
            return
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                if tag in INLINE and self.stack[k][2] and not self.stack[k - 1][2] and self.buffer:
                    self.buffer.append(" ")
                del self.stack[k:]
                return
            if tag in INLINE and name not in INLINE:
                return


def scores(blocks: list[Block]) -> np.ndarray:
    """Fused, smoothed ratio of each block's path, times its prior."""
    paths = {p: k for k, p in enumerate(dict.fromkeys(b.path for b in blocks))}
    which = np.array([paths[b.path] for b in blocks])
    nodes = np.bincount(which)
    length = np.bincount(which, [min(MOST_LENGTH, len(b.text) - (0 if b.article else min(b.linked, len(b.text)))) for b in blocks]) / nodes
    marks = np.bincount(which, [min(MOST_MARKS, len(_PUNCTUATION.findall(b.text))) for b in blocks]) / nodes
    prior = np.array([NOISE_PRIOR if b.noise else ARTICLE_PRIOR if b.article else 1.0 for b in blocks])
    noise = np.array([NOISE_PRIOR if b.noise else 1.0 for b in blocks])
    fused = (np.log1p(length) * (1 + np.log1p(marks)))[which] * prior
    padded = np.concatenate([fused[:1], fused, fused[-1:]])
    smooth = (0.15 * padded[:-2] + 0.7 * fused + 0.15 * padded[2:]) * noise  # noise beside content stays noise
    return (np.bincount(which, smooth) / nodes)[which]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, one a line."""
    found = _Page(page or "")
    blocks = found.blocks
    if not blocks:
        return ""
    score = scores(blocks)
    content = score >= max(LEAST_SCORE, score.std(), CONTENT_SHARE * score.max())
    if not content.any():
        return ""
    shared = set.intersection(*(set(b.around) for b, c in zip(blocks, content) if c))
    inner = max((e for e in shared if found.names[e] in CONTAINERS), default=None)
    near = score >= INNER_SHARE * score.max()
    own = [b.text for b, c, n in zip(blocks, content, near) if c or n and (inner is None or inner in b.around) and (b.article or 2 * b.linked < len(b.text))]
    return "\n".join(own)


def extracted(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page: the kept columns, text, n_chars (code points)."""
    kinds = dict(pages.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow.forget()
        for batch, col in arrow.sliced(batches, "quillveil_html"):
            out = [main_text(x) for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*keep, "text", "n_chars"])

    rows = arrow.modest(pages).select(*keep, F.col(html_col).cast("string").alias("quillveil_html"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long")
