"""Main text of web pages by tree scoring.

Markup is read into a tree of elements with blocks of text. Each block passes points for its length and its commas,
discounted by the share of its text that stands in links, to its ancestors: all to the nearest container, half to the
next, and less to those above. A container's points are discounted by its own link density. The container with the most
points is kept, or the article or main element it stands in; otherwise also its siblings with enough points and sibling
paragraphs of plain text. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are told by their elements and roles, or as lists that are mostly links, and never take part. Class names and ids
only lower the points of what is inside, little for a word of a longer name, much for a whole name, and never those of text
blocks or of what an article or main element stands in. Elements with a whole such name are left out beside the container
that is kept, and in it only if it is the page or its body; but adverts, comments, share bars and the like, by a whole name, are
left out of any container unless they hold more than half of its text. Time grows with the page's length, however deep
elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea iframe title".split())
#: Elements without text of the page; they end like others, with their parent at the latest.
_EMPTY = frozenset("template svg select".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold text rather than other blocks: their points start at the parent.
_TEXT = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption address summary".split())
_DROPPED = frozenset("nav aside footer form menu dialog button fieldset head".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside comment comments disqus respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget pagination pager toolbar skip".split()
)
#: Whole names of what doesn't belong to an article even in its middle.
_FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription cookie cookies consent gdpr popup modal overlay breadcrumb breadcrumbs pagination pager sidebar nav navbar".split()
)
#: Ancestors that a block passes points to, at most; farther ones would get less than a hundredth.
_REACH = 64
_WHOLE = frozenset(["html", "body", "article", "main"])
#: What a word of a class name or id, and a whole one, leave of the points inside.
_WORTH = (1.0, 0.5, 0.1)
#: Open elements that a start tag ends, up to the elements that bound the search.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_LISTS = frozenset("ul ol dl div section table".split())


class Page:
    """Elements (tag, parent, whether an article) and blocks (element, text, characters in links) of one page."""

    def __init__(self, source: str):
        self.tags, self.parents, self.named, self.foreign, self.blocks = ["#page"], [-1], [0], [False], []
        self._opened, self._endless = Counter(), set()  # open elements by tag; raw elements that no end tag follows any more
        self._stack, self._parts, self._linked, self._skip, self._links = [0], [], 0, 0, 0  # _links: open a elements
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            closed = attributes.rstrip().endswith("/")
            if tag in _RAW and not (closed and tag not in ("script", "style")):
                close = None if tag in self._endless else re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                if close is None:
                    self._endless.add(tag)
                at = close.end() if close else end if tag in ("script", "style") and not closed else at
            elif tag not in _RAW and not (closed and (tag in _EMPTY or tag == "math")):
                self._open(tag, attributes)
        self._flush()

    def _text(self, text: str) -> None:
        if text and not self._skip:
            self._parts.append(text)
            if self._links:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                owner = next((i for i in reversed(self._stack) if self.tags[i] in _BLOCKS), 0)
                self.blocks.append((owner, text, min(self._linked, len(text))))
        self._parts, self._linked = [], 0

    def _pop(self, size: int) -> None:
        self._links -= sum(self.tags[i] == "a" for i in self._stack[size:])
        self._opened.subtract(self.tags[i] for i in self._stack[size:])
        del self._stack[size:]
        if self._skip and len(self._stack) < self._skip:
            self._skip = 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            self._end_paragraph()
            if tag in _ENDS:
                ended, bounds = _ENDS[tag]
                for k in range(len(self._stack) - 1, 0, -1) if any(self._opened[t] for t in ended) else ():
                    if self.tags[self._stack[k]] in bounds:
                        break
                    if self.tags[self._stack[k]] in ended:
                        self._pop(k)
                        break
        elif tag == "br":
            self._text(" ")
        if tag in _VOID:
            return
        inside = self._opened["article"] + self._opened["main"] > 0
        self._opened[tag] += 1
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.tags) - 1)
        self._links += tag == "a"
        self.named.append(self._named(attributes, inside) if attributes and tag not in _WHOLE and tag not in _TEXT else 0)
        self.foreign.append(bool(attributes) and tag not in _WHOLE and tag not in _TEXT and self._whole_name(attributes))
        if not self._skip and tag in _EMPTY:
            self._skip = len(self._stack)
        if not self._skip and tag not in _WHOLE and (tag in _DROPPED or tag == "header" and not inside or attributes and self._unwanted(attributes)):
            self._flush()
            self._skip = len(self._stack)

    def _unwanted(self, attributes: str) -> bool:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _DROPPED_ROLES:
                return True
        return False

    def _named(self, attributes: str, inside: bool) -> int:
        """2 if a class name or the id is that of something else than text, 1 if a word of them is."""
        found = 0
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() in ("class", "id") and value:
                if any(w in _DROPPED_NAMES or not inside and w == "header" for w in value.lower().split()):
                    return 2
                words = {w.lower() for w in _NAME.findall(value)}
                if words & _DROPPED_NAMES or not inside and "header" in words:
                    found = 1
        return found

    def _whole_name(self, attributes: str) -> bool:
        return any(m[1].lower() in ("class", "id") and not _FOREIGN.isdisjoint((m[2] or m[3] or m[4] or "").lower().split()) for m in _ATTRIBUTE.finditer(attributes))

    def _end_paragraph(self) -> None:
        if not self._opened["p"]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[k]]
            if tag == "p":
                self._pop(k)
                return
            if tag in _BLOCKS:
                return

    def _close(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._flush()
        if not self._opened[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            other = self.tags[self._stack[k]]
            if other == tag:
                self._pop(k)
                return
            if other in _BLOCKS and tag not in _BLOCKS:
                return  # an inline end tag doesn't end blocks

    def main_blocks(self) -> list[str]:
        n = len(self.tags)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        named, left = list(self.named), [1.0] * n
        above = [t in ("article", "main") for t in self.tags]  # articles and what they stand in
        for i in range(n - 1, 0, -1):
            above[self.parents[i]] |= above[i]
        for i in range(n):
            if above[i]:
                named[i] = 0
        for i in range(1, n):
            left[i] = left[self.parents[i]] * _WORTH[named[i]]
        for owner, text, link in self.blocks:
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link / len(text)) * left[owner]
            node, level = (self.parents[owner] if self.tags[owner] in _TEXT and owner else owner), 0
            while node >= 0 and level < _REACH:
                points[node] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                node, level = self.parents[node], level + 1
            chars[owner] += len(text)
            linked[owner] += link
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        if not self.blocks:
            return []
        score = [p * (1 - k / c) if c else 0.0 for p, c, k in zip(points, chars, linked, strict=True)]
        best = max(range(n), key=lambda i: score[i])
        kept, node = {best}, best
        while node >= 0 and self.tags[node] not in ("article", "main"):
            node = self.parents[node]
        whole = chars[node if node >= 0 else best]
        if node >= 0:
            kept = {node}
        elif best:
            up = self.parents[best]
            plain = lambda i: self.tags[i] == "p" and chars[i] > 80 and linked[i] < 0.25 * chars[i]
            kept |= {i for i in range(1, n) if self.parents[i] == up and named[i] < 2 and (score[i] >= max(10, 0.2 * score[best]) or plain(i))}
        # Nested elements come after their parents, so one pass settles who is inside and who is a list of links.
        state, open_ = [False] * n, node < 0 and self.tags[best] in ("#page", "html", "body")
        for i in range(n):
            state[i] = i in kept or (i > 0 and state[self.parents[i]])
            if state[i] and i not in kept and (self.tags[i] in _LISTS and linked[i] > 0.5 * chars[i] or open_ and named[i] == 2 or self.foreign[i] and not above[i] and 2 * chars[i] <= whole):
                state[i] = False
        return [text for owner, text, _ in self.blocks if state[owner]]


def main_text(source: str | None) -> str:
    """The page's main text, one line for each block."""
    return "\n".join(Page(source).main_blocks()) if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html and a page without text give "" and 0. One result row for each row, in one pass without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py()) for s in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
