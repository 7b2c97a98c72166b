"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat list of text blocks: runs of text between block-level
tags, in page order.  A block is described by its own and its neighbours' word
counts and link densities and by where it stands (inside an article, inside a
navigation, header, footer, aside or form element, under an element whose class
or id names such a part, in a heading).  A wrapper of the page is no part: a
form that holds most of the page's words, or an element with such a name that
holds the main element, or most words with a top heading or an article among
them.  A decision tree, trained on the small
labelled table below, says which blocks are main text.

The extraction is a map over the pages: no shuffle, memory of one batch.

Edge cases: a null page is an empty one, without text; broken markup is read
as far as it goes, in time linear in its length (unclosed elements end with
their parent, a ``<`` that no ``>`` outside quotes closes is text); repeated rows are read each; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is not text of the page,
# elements that do not break a block, elements without end tag.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "title", "iframe", "object",
          "canvas", "audio", "video", "textarea", "select", "option", "button", "datalist", "map")
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
                  "source", "track", "wbr"))
PART_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "header"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class or id that name a part beside the main text.
PART_NAMES = frozenset((
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "paywall",
    "popup", "promo", "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "widget"))
#: First words of a class that tell a page's state ("has-sidebar"), not a part.
STATES = frozenset(("has", "no", "with", "without"))
#: Part elements that are never taken for a wrapper of the page.
NEVER_WIDE = PART_TAGS - {"form", "fieldset"}

_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT}

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after",
            "link_density_after", "in_article", "in_part", "heading")


def _named_part(attributes: str, in_article: bool) -> bool:
    """A class, id or role names a part beside the main text (an article has its own header)."""
    names = PART_NAMES - {"header"} if in_article else PART_NAMES
    for m in _NAMES.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        for token in value.split():
            words = _SPLIT.split(token)
            if words[0] not in STATES and not names.isdisjoint(words):
                return True
    return False


class Scanner:
    """Tags of a page in linear time, whatever the markup.

    What was looked for once and lies ahead, or is not there, is not looked
    for again: the next name end and the next ``>`` or quote serve every ``<``
    before them, and where a tag ends is known for each quote.
    """

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.ahead: dict[re.Pattern, tuple[int, int]] = {}
        self.closed: dict[int, int] = {}

    def next(self, what: re.Pattern, at: int) -> int:
        """The first place from ``at`` on, or the page's end."""
        start, found = self.ahead.get(what, (0, -1))
        if not start <= at <= found:
            m = what.search(self.page, at)
            found = m.start() if m else self.end
            self.ahead[what] = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """The ``>`` that ends a tag, outside quotes; -1 if a quote or the tag is left open."""
        passed = []
        spot = self.next(_SPECIAL, at)
        while spot < self.end and self.page[spot] != ">" and spot not in self.closed:
            passed.append(spot)
            other = self.page.find(self.page[spot], spot + 1)
            spot = self.end if other < 0 else self.next(_SPECIAL, other + 1)
        found = self.closed.get(spot, spot if spot < self.end else -1)
        self.closed.update(dict.fromkeys(passed, found))
        return found

    def tags(self):
        """(start, end, name or None, closing, attributes) of tags, comments and
        declarations; the caller may send the place to go on from."""
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= self.end:
                return
            at, kind = start + 1, page[start + 1]
            if kind == "!" and page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                found = start, self.end if stop < 0 else stop + 3, None, False, ""
            elif kind in "!?":
                stop = page.find(">", at)
                found = start, self.end if stop < 0 else stop + 1, None, False, ""
            else:
                first = at + (kind == "/")
                if first >= self.end or not ("a" <= page[first].lower() <= "z"):
                    continue
                named = self.next(_NAME_END, first)
                stop = self.tag_end(named)
                if stop < 0:
                    continue
                attributes = page[named:stop]
                found = start, stop + 1, page[first:named].lower(), kind == "/", attributes.removesuffix("/")
            at = found[1]
            sent = yield found
            if sent is not None:
                at = sent
                yield None


class Block:
    __slots__ = ("text", "words", "linked", "article", "part", "heading", "label")

    def __init__(self, text, words, linked, article, part, heading, label):
        self.text, self.words, self.linked = text, words, linked
        self.article, self.part, self.heading, self.label = article, part, heading, label


class _Part:
    """An element beside the main text, or a wrapper of the page (as the page itself is)."""
    __slots__ = ("above", "fixed", "form", "words", "sure", "likely", "wrapper")

    def __init__(self, above, fixed, form=False):
        self.above, self.fixed, self.form = above, fixed, form
        self.words, self.sure, self.likely, self.wrapper = 0, False, False, True


def text_blocks(page: str) -> list[Block]:
    """Blocks of a page in order, white space as one space, references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, str | None]] = []  # element, in article, innermost part, label
    article = part = 0
    parts = [_Part(0, False)]  # the page itself is the first
    label: str | None = None
    pieces: list[tuple[str, bool]] = []
    in_link, heading, own, at, end = 0, False, False, 0, len(page)

    def close() -> None:
        if pieces:
            # References do not span tags, so each piece is decoded by itself.
            text = " ".join("".join(unescape(t) if "&" in t else t for t, _ in pieces).split())
            if text:
                linked = sum(len(t.split()) for t, link in pieces if link)
                words = text.count(" ") + 1
                parts[part].words += words
                found.append(Block(text, words, linked, article > 0, -1 if own else part, heading, label))
            pieces.clear()

    tags = Scanner(page).tags()
    unclosed, held = set(), Counter()  # silent elements without an end ahead; open elements by name
    for start, after, name, closing, attributes in tags:
        if start > at:
            pieces.append((page[at:start], in_link > 0))
        at = after
        if name is None:  # a comment or declaration
            continue
        if name in _END:
            if not closing and name not in unclosed:
                stop = _END[name].search(page, at)
                if stop is not None:
                    at = stop.end()
                else:
                    unclosed.add(name)
            if not closing and name in unclosed and name in ("script", "style", "title", "textarea"):
                at = end
            if at > after:
                tags.send(at)
            if name not in ("script", "style"):
                close()
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        close()
        own = False
        if name in VOID:
            continue
        if name in HEADINGS:
            heading = not closing
            if name == "h1":
                parts[part].likely = True
        if closing:
            if held[name]:  # all above it end with it
                while True:
                    inner, article, part, label = stack.pop()
                    held[inner] -= 1
                    if inner == name:
                        break
                in_link = 0
            continue
        if name == "p" or name == "li":  # ended by the next block; marks this one only
            own = bool(attributes) and (_named_part(attributes, article > 0) or bool(_HIDDEN.search(attributes)))
            continue
        stack.append((name, article, part, label))
        held[name] += 1
        if name in ("article", "main"):
            if name == "main":
                parts[part].sure = True
            elif not article and not _named_part(attributes, True):
                parts[part].likely = True
            article += 1
        elif name in NEVER_WIDE and not (name == "header" and article) or attributes and _HIDDEN.search(attributes) \
                and name not in ("html", "body"):
            parts.append(_Part(part, True))
            part = len(parts) - 1
        elif name in ("form", "fieldset") or attributes and name not in ("html", "body") \
                and _named_part(attributes, article > 0):
            parts.append(_Part(part, False, name == "form"))
            part = len(parts) - 1
        if attributes and (told := re.search(r"data-main=\"([01])\"", attributes)):
            label = told[1]
    if at < end:
        pieces.append((page[at:], in_link > 0))
    close()
    for p in reversed(parts[1:]):
        above = parts[p.above]
        above.words += p.words
        above.sure |= p.sure
        above.likely |= p.likely
    for p in parts[1:]:
        p.wrapper = parts[p.above].wrapper and not p.fixed and (
            p.sure or (p.likely or p.form) and 2 * p.words > parts[0].words)
    for b in found:
        b.part = b.part < 0 or not parts[b.part].wrapper
    return found


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in blocks], float)
        density = np.array([min(1.0, b.linked / b.words) for b in blocks])
        out[:, 0], out[:, 1] = words, density
        out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
        out[:, 6] = [b.article for b in blocks]
        out[:, 7] = [b.part for b in blocks]
        out[:, 8] = [b.heading for b in blocks]
    return out


# --- the labelled table ----------------------------------------------------
# Small pages; data-main says whether the blocks under it are main text.  N*
# stands for N words.
LABELLED = (
    '<nav data-main="0"><ul><li><a>2*</a></li><li><a>1*</a></li><li><a>3*</a></li></ul></nav>'
    '<article data-main="1"><h1>7*</h1><p>60*</p><p>2*</p><p>1*</p><p>95*</p></article>'
    '<footer data-main="0">9*</footer>',
    '<header data-main="0"><p>4*</p><a>1*</a></header><div class="ad" data-main="0">14*</div>'
    '<main data-main="1"><h2>3*</h2><p>1*</p><p>30* <a>2*</a> 8*</p><p>12*</p></main>'
    '<aside data-main="0"><p>25*</p><p><a>6*</a></p></aside><footer data-main="0">30* <a>2*</a></footer>',
    '<article data-main="1"><h1>1*</h1><p>1*</p></article><footer data-main="0">12*</footer>',
    '<div class="cookie-notice" data-main="0">28* <a>2*</a></div><article data-main="1"><p>3*</p><p>150*</p>'
    '<div class="advert" data-main="0">9*</div><p data-main="1">40*</p>'
    '<div class="comments" data-main="0"><p>35*</p><p>4*</p></div></article>',
    '<div class="sidebar" data-main="0"><p>18*</p><ul><li><a>5*</a></li><li><a>4*</a></li></ul></div>'
    '<div data-main="1"><h1>6*</h1><p>45*</p><p>70*</p><p>33* <a>3*</a></p></div>'
    '<div data-main="0"><a>3*</a><br><a>4*</a></div><div data-main="0">4*</div>',
    '<div data-main="0"><a>1*</a></div><div data-main="0"><a>2*</a> 1*</div>'
    '<div data-main="1"><p>52*</p><p>26*</p><p>90*</p></div><form data-main="0"><p>11*</p></form>'
    '<section id="comments" data-main="0"><p>48*</p><p>20*</p></section>',
    '<div data-main="0">3*</div><div data-main="0"><a>2*</a></div><div data-main="1"><p>120*</p></div>'
    '<div data-main="0"><a>4*</a></div><div data-main="0">2* <a>2*</a></div>',
    '<article data-main="1"><h1>5*</h1><p><a>6*</a></p><p>18* <a>9*</a></p><blockquote>22*</blockquote>'
    '<ul><li>3*</li><li>8*</li></ul><aside data-main="0">16*</aside><p>64*</p></article>'
    '<div class="related" data-main="0"><a>7*</a><p>20*</p></div>',
    '<article data-main="1"><p>2*</p><p>80*</p><p>1*</p></article>',
    '<article data-main="1"><h1>4*</h1><p>6*</p><p><a>3*</a></p></article>',
    '<article data-main="1"><p>1*</p></article>',
    '<article data-main="1"><p>200*</p></article>',
    '<article data-main="1"><p><a>2*</a></p><p>4*</p></article>',
    '<section data-main="1"><p>70*</p></section>',
    '<section data-main="1"><p>24*</p><p>31*</p></section>',
    '<section data-main="1"><h1>5*</h1><p>40*</p><p>9*</p><p>66*</p></section>',
    '<div data-main="0"><a>1*</a></div><section data-main="1"><p>80*</p><p>16*</p></section>',
    '<section data-main="1"><p>35*</p></section><div data-main="0"><a>3*</a></div>',
    # Short blocks are judged by their neighbours: between paragraphs they are text, beside links not.
    '<div data-main="1"><h1>2*</h1><p>4*</p><p>2*</p></div>',
    '<section data-main="1"><h1>3*</h1><p>45*</p><h2>2*</h2><p>50*</p><p>2*</p></section>',
    '<section data-main="1"><h1>3*</h1><p>30*</p><p>1*</p><p>3*</p><p>28*</p></section>',
    '<section data-main="1"><p>2*</p><p>64*</p><p>4*</p></section>',
    '<div data-main="0"><a>2*</a></div><div data-main="0">3*</div><div data-main="0"><a>1*</a></div><div data-main="1"><p>40*</p></div>',
    '<div data-main="0"><a>3*</a></div><div data-main="0">1*</div><div data-main="0"><a>2*</a></div>'
    '<section data-main="1"><h1>4*</h1><p>75*</p><p>3*</p></section>',
    '<section data-main="1"><p>52*</p></section><div data-main="0"><a>2*</a></div><div data-main="0">2*</div><div data-main="0"><a>4*</a></div>',
)
MIN_LEAF, DEPTH = 1, 6


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """(features, is main text) of every block of the labelled pages."""
    rows, labels = [], []
    for page in LABELLED:
        body = re.sub(r"(\d+)\*", lambda m: " ".join(["word"] * int(m[1])), page)
        blocks = text_blocks(f"<html><body>{body}</body></html>")
        rows.append(features(blocks))
        labels += [b.label == "1" for b in blocks]
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A classification tree by Gini impurity: (feature, cut, left, right) or a label.

    Ties go to the earlier feature and the smaller cut, a leaf's tie to main text.
    """
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            n, m = left.sum(), (~left).sum()
            if min(n, m) < MIN_LEAF:
                continue
            p, q = y[left].mean(), y[~left].mean()
            cost = n * p * (1 - p) + m * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(cut), left
    if best is None:
        return bool(2 * y.sum() >= len(y))
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def train():
    return grow(*labelled_table())


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    left = x[:, f] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_text(page: str | None, tree) -> str:
    blocks = text_blocks(page or "")
    return " ".join(b.text for b, keep in zip(blocks, classify(tree, features(blocks))) if keep)


def _extract(tree, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(kind), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())],
                schema=schema)
    return run


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (id, url, text), one per page row."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_extract(train(), to_arrow_type(kind)), f"id {kind.simpleString()}, url string, text string")
