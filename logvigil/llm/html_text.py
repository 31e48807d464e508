"""Main text of web pages by tree scoring.

A page is read into a tree as browsers do it (elements closed by what follows, text of scripts as text). Its blocks pass points
for length and commas to the containers above them, discounted by the share of linked text. The container with the most
points is kept, with siblings that score well; menus, adverts, notices, forms and comments inside them are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches, texts_of

SIBLING_SHARE = 0.2  # a sibling is kept with this share of the best container's points
MENU_LINKS, MENU_SHARE = 3, 0.8  # a part of so many links or more, whose text is linked to this share, is a menu

# Fixed values of HTML: elements without content, with raw text, and those that stand in a line.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var button select option textarea input svg math canvas audio video object map "
    "script style noscript template iframe picture".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section search summary table ul".split()
)
_SCOPE = frozenset("table td th caption template html button object".split())
# An element closes open ones of the first group, as far as the nearest of the second.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Blocks that pass their points to the container above; containers are where points are gathered.
_CONTAINERS = frozenset("#root html body main article section div center td form details".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts that never belong to the article.
_LEFT_OUT = frozenset(
    "head title nav footer aside menu form script style noscript template iframe noembed noframes xmp svg math canvas audio video object "
    "map button select textarea input dialog search".split()
)
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
# Words of a class or id that speak for a part that is no article.
_ODD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar widget footer masthead toolbar pagination pager cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments commentlist disqus replies respond skip".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond reply".split())
_GOOD_WORDS = frozenset("article body content entry main post story text".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_TAG_END = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+>")
_COMMENT_END = re.compile(r"-->|--!>|(?<=<!--)-?>")
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Page:
    """The tree of a page: per node its element, parent, words of class and id, role; and the page's blocks in order.

    A block is a node and the pieces of text between two borders of blocks, each with its innermost node.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.role, self.linked = ["#root"], [-1], [frozenset()], [""], [False]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._open, self._count, self._pieces = [0], {}, []
        self._paragraphs: list[int] = []  # places of open p elements in the stack
        self._scopes: list[int] = []
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            self._text(html[at : m.start()])
            if m[1]:
                end = _COMMENT_END.search(html, m.end())
            elif m[3]:
                end = _TAG_END.match(html, m.end())
            else:
                end = re.compile(">").search(html, m.end())
            if end is None:  # the page ends inside the tag
                return
            at = end.end()
            if not m[3]:
                continue
            name = m[3].lower()
            if m[2]:
                self._end(name)
                continue
            self._start(name, html[m.end() : end.end() - 1])
            if name in _RAW:
                close = _RAW_END[name].search(html, at)
                self._end(name)
                if close is None:
                    return
                at = close.start()
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text:
            self._pieces.append((self._open[-1], text))

    def _flush(self) -> None:
        if self._pieces:
            k = len(self._open) - 1
            while self.tag[self._open[k]] in _INLINE:
                k -= 1
            self.blocks.append((self._open[k], self._pieces))
            self._pieces = []

    def _push(self, name: str, attributes: str) -> None:
        found = {}
        for key, *values in _NAMES.findall(attributes):
            found.setdefault(key.lower(), "".join(values))
        words = _NAME_WORDS.findall(unescape(f"{found.get('class', '')} {found.get('id', '')}"))
        above = self._open[-1]
        self._open.append(len(self.tag))
        self.tag.append(name)
        self.parent.append(above)
        self.words.append(frozenset(w.lower() for w in words))
        self.role.append(found.get("role", "").strip().lower())
        self.linked.append(self.linked[above] or name == "a")
        self._count[name] = self._count.get(name, 0) + 1
        if name == "p":
            self._paragraphs.append(len(self._open) - 1)
        elif name in _SCOPE:
            self._scopes.append(len(self._open) - 1)

    def _pop_to(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        if any(self.tag[n] not in _INLINE for n in self._open[place:]):
            self._flush()
        for n in self._open[place:]:
            self._count[self.tag[n]] -= 1
        del self._open[place:]
        for places in (self._paragraphs, self._scopes):
            while places and places[-1] >= place:
                places.pop()

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            self._text(" " if name == "br" else "")
            return
        if name not in _INLINE:
            self._flush()
        if name in _CLOSES_P and self._paragraphs and self._paragraphs[-1] > (self._scopes[-1] if self._scopes else 0):
            self._pop_to(self._paragraphs[-1])
        if name in _IMPLIED:
            closed, border = _IMPLIED[name]
            if any(self._count.get(c) for c in closed):
                place = self._find(closed, border)
                if place:
                    self._pop_to(place)
        elif name == "a" and self._count.get("a"):
            self._end("a")
        if name not in _VOID:
            self._push(name, attributes)

    def _find(self, names: set[str], border: frozenset | set[str]) -> int:
        """Place of the innermost open element of these names, before any border; 0 without one."""
        for place in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[place]]
            if tag in names:
                return place
            if tag in border:
                return 0
        return 0

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        if not self._count.get(name):
            return
        if name in _INLINE:
            place = len(self._open) - 1
            while self.tag[self._open[place]] != name:
                if self.tag[self._open[place]] not in _INLINE:
                    return  # a block stands inside; it goes on
                place -= 1
        else:
            place = self._find({name}, _SCOPE - {name})
        if place:
            self._pop_to(place)

    def left_out(self) -> list[bool]:
        """For every node whether it lies in a part that is no article."""
        article = [t in ("article", "main") and not w & _COMMENT_WORDS for t, w in zip(self.tag, self.words)]
        holds = article[:]
        for n in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[n]] |= holds[n]
        out, inside = [False], [False]
        for n in range(1, len(self.tag)):
            up, tag = self.parent[n], self.tag[n]
            inside.append(inside[up] or article[n])
            odd = tag in _LEFT_OUT or self.role[n] in _LEFT_OUT_ROLES or bool(self.words[n] & _ODD_WORDS)
            if tag == "header" and not inside[up]:
                odd = True
            if tag in ("html", "body"):
                odd = False
            if holds[n]:  # what holds an article is no odd part of it
                odd = False
            # of an article's own header its headings belong to the text
            if self.tag[up] == "header" and inside[up] and tag not in _HEADINGS:
                odd = True
            out.append(out[up] or odd)
        return out


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by an empty line."""
    page = _Page(html)
    tag, parent, total = page.tag, page.parent, len(page.tag)
    out = page.left_out()
    blocks = []  # owner, text, linked characters
    for owner, pieces in page.blocks:
        kept = [(page.linked[n], unescape(text)) for n, text in pieces if not out[n]]
        text = " ".join("".join(t for _, t in kept).split())
        if text and not out[owner] and not (tag[owner] == "header"):
            blocks.append((owner, text, min(len(text), sum(len("".join(t.split())) for on, t in kept if on))))
    chars, linked, links = [0] * total, [0] * total, [0] * total
    for owner, text, on in blocks:
        chars[owner] += len(text)
        linked[owner] += on
    for n in range(total - 1, 0, -1):
        links[n] += tag[n] == "a"
        for sums in (chars, linked, links):
            sums[parent[n]] += sums[n]
    menu = [False] * total
    for n in range(1, total):
        dense = links[n] >= MENU_LINKS and linked[n] >= MENU_SHARE * chars[n] > 0
        menu[n] = menu[parent[n]] or (dense and tag[n] not in ("html", "body", "article", "main"))
    blocks = [b for b in blocks if not menu[b[0]]]
    if not blocks:
        return ""

    points = [0.0] * total
    for owner, text, on in blocks:
        worth = (1 + len(text) / 100 + text.count(",")) * (1 - on / len(text))
        n = owner
        for level in (1, 2, 3):  # the nearest containers share the points
            while n >= 0 and tag[n] not in _CONTAINERS:
                n = parent[n]
            if n < 0:
                break
            points[n] += worth / level
            n = parent[n]
    score = [0.0] * total
    for n in range(total):
        if points[n]:
            weight = 4 if tag[n] == "article" else 3 if tag[n] == "main" else 1.5 if page.words[n] & _GOOD_WORDS else 1
            score[n] = points[n] * weight * (1 - linked[n] / max(chars[n], 1))
    best = max(range(total), key=lambda n: (score[n], -n))
    up = best
    while up > 0 and tag[up] != "article":
        up = parent[up]
    best = up or best  # an article is one text, whichever of its parts is the largest

    inside = [n == best for n in range(total)]
    _spread(inside, parent)
    headed = any(tag[owner] in _HEADINGS for owner, *_ in blocks if inside[owner])
    for n in range(1, total):
        if n == best or parent[n] != parent[best] or out[n] or menu[n] or not chars[n]:
            continue
        if score[n] >= SIBLING_SHARE * score[best] > 0 or (
            tag[n] in ("p", "blockquote", "pre", "ul", "ol", "table", "figure") and tag[best] not in ("article", "main") and linked[n] < 0.5 * chars[n]
        ):
            inside[n] = True
        elif tag[n] in _HEADINGS and n < best and not headed and linked[n] < 0.5 * chars[n]:
            inside[n] = True
    _spread(inside, parent)
    return "\n\n".join(text for owner, text, _ in blocks if inside[owner])


def _spread(inside: list[bool], parent: list[int]) -> None:
    """Mark all nodes below marked ones."""
    for n in range(1, len(inside)):
        inside[n] |= inside[parent[n]]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the main text of the whole page and its number of characters.

    Null and empty pages, and pages without text outside menus, forms and the like, have an empty text. Character references are
    decoded, white space inside a block becomes one blank, blocks are joined by an empty line; nothing is shortened. Repeated
    rows, null ids and urls stay as they are; other columns are ignored. A page is read in one pass, however deep or broken.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_batches(batch, "html"):
                texts = [main_text(html) for html in texts_of(part, "html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, f"page_id {kind}, url {url_kind}, text string, n_chars bigint")
