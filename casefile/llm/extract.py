"""Main text of HTML pages by tree scoring.

Every block with text of its own is a paragraph. It earns points for its length and commas, which its parent takes in
full, its grandparent by half and further ancestors in falling shares; a container's points are discounted by its link
density. The best container is kept with those siblings that score well beside it; menus, headers, footers, sidebars,
notices, adverts, forms and comments inside it go.

Pages are parsed in one pass into flat lists (parent, tag, state of each element; text pieces in page order), without
recursion, so depth and length are bounded by memory for one page only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element names of HTML, and words that name parts of a page in class, id and role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
GONE = frozenset("script style textarea title noscript iframe noembed noframes xmp head template object svg math canvas button select option datalist dialog menu nav footer audio video input".split())
PARTS = frozenset("aside form header".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img svg math".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
LIMITS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
JUNK = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain
    overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox
    sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets alert complementary contentinfo""".split()
)
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
BONUS = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "pre": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Page:
    """Flat tree of a page: element k has ``parent[k]`` < k, ``tag[k]`` and ``drop[k]``; ``pieces`` holds (element, text or None for a break)."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.drop = [-1], ["body"], [False]
        self.weak = [False]  # dropped unless it holds the article
        self.readers = [False]
        self.pieces: list[tuple[int, str | None]] = []
        stack, at, end = [0], 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                text = html[at:stop]
                self.pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
            elif name in ("html", "body"):
                continue
            else:
                at = self._open(stack, name, m[3], html, at)

    def _open(self, stack: list[int], name: str, attributes: str, html: str, at: int) -> int:
        if name not in INLINE:
            self._imply(stack, name)
            self.pieces.append((stack[-1], None))
        if name in VOID:
            return at
        k = len(self.tag)
        self.parent.append(stack[-1])
        self.tag.append(name)
        words, hidden = _words(attributes)
        self.drop.append(name in GONE or hidden)
        self.readers.append(bool(words & READERS))
        self.weak.append(name in PARTS or bool(words & JUNK))
        if name in RAW:
            found = RAW_ENDS[name].search(html, at)
            return found.end() if found else len(html)
        if not attributes.endswith("/") or name not in ("svg", "math"):
            stack.append(k)
        return at

    def _imply(self, stack: list[int], name: str) -> None:
        """Start tags that end open elements: a block ends a paragraph, an item the item before it."""
        for j in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[j]]
            if tag == "p":
                del stack[j:]
                break
            if tag not in INLINE:
                break
        if name in CLOSES:
            ends, limit = CLOSES[name].split(), LIMITS[name].split()
            cut = None
            for j in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[j]]
                if tag in limit:
                    break
                if tag in ends:
                    cut = j
            if cut:
                del stack[cut:]

    def _close(self, stack: list[int], name: str) -> None:
        if name not in INLINE:
            self.pieces.append((stack[-1], None))
        for j in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[j]]
            if tag == name:
                del stack[j:]
                return
            if name in INLINE and tag not in INLINE:
                return  # an inline end tag does not end a block

    def text(self) -> str:
        return " ".join("".join(" " if t is None else t for k, t in self.pieces if self.kept[k]).split())

    def extract(self) -> str:
        """Scores the tree and returns the text of the best container and its good siblings."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        gone = self.drop[:]
        for k in range(1, n):
            gone[k] = gone[k] or gone[parent[k]]
        block = [0] * n  # the block that an element's own text belongs to
        link = [False] * n
        for k in range(1, n):
            block[k] = block[parent[k]] if tag[k] in INLINE else k
            link[k] = tag[k] == "a" or link[parent[k]]
        own: dict[int, list[str]] = {}
        length, linked = [0] * n, [0] * n
        for k, t in self.pieces:
            if t is not None and not gone[k] and (size := len("".join(t.split()))):
                own.setdefault(block[k], []).append(t)
                length[k] += size
                linked[k] += size if link[k] else 0
        points = {k: self._points(" ".join(" ".join(parts).split())) for k, parts in own.items()}
        held, articles, titles = [0.0] * n, [0] * n, [0] * n
        for k, p in points.items():
            held[k] += p
        for k in range(n - 1, 0, -1):  # children come after their parents
            if tag[k] in ("article", "main") and not gone[k] and not self.readers[k]:
                articles[k] += 1
            titles[k] += tag[k] == "h1" and not gone[k]
            p = parent[k]
            length[p], linked[p], held[p] = length[p] + length[k], linked[p] + linked[k], held[p] + held[k]
            articles[p], titles[p] = articles[p] + articles[k], titles[p] + titles[k]
        # parts named as junk go, but not a wrapper around the article itself
        inside = [False] * n
        for k in range(1, n):
            inside[k] = inside[parent[k]] or tag[parent[k]] in ("article", "main") and not self.readers[parent[k]]
            if self.weak[k] and not gone[k]:
                wraps = tag[k] not in ("header", "aside") and (articles[k] - (tag[k] in ("article", "main")) > 0 or titles[k] and held[k] > 0.5 * held[0])
                if tag[k] == "main" or tag[k] == "article" and not self.readers[k]:
                    wraps = True
                gone[k] = not wraps
            gone[k] = gone[k] or gone[parent[k]]
        kept_heads = [False] * n  # headings in the article's own header stay
        for k in range(1, n):
            if tag[k] in HEADINGS and gone[k] and inside[k]:
                up = parent[k]
                while tag[up] not in ("article", "main", "body"):
                    if tag[up] != "header" and (self.drop[up] or self.weak[up]):
                        break
                    up = parent[up]
                kept_heads[k] = tag[up] in ("article", "main") and not gone[up]
            elif parent[k] >= 0 and kept_heads[parent[k]] and not self.drop[k]:
                kept_heads[k] = True
        score: dict[int, float] = {}
        for k, p in points.items():
            if gone[k]:
                continue
            up, level = (parent[k] if k else 0), 0
            while up >= 0 and level < 6:
                while up > 0 and tag[up] in INLINE:
                    up = parent[up]
                score[up] = score.get(up, BONUS.get(tag[up], 0.0)) + p / (1, 2, 6, 9, 12, 15)[level]
                up, level = parent[up], level + 1
        density = lambda k: linked[k] / length[k] if length[k] else 0.0
        final = {k: s * (1 - density(k)) for k, s in score.items()}
        self.kept = [False] * n
        if not final:
            return ""
        best = min(final, key=lambda k: (-final[k], k))
        up = best
        while up > 0 and not (tag[up] in ("article", "main") and not gone[up]):
            up = parent[up]
        roots = {up} if up > 0 else {best}
        top = up if up > 0 else best
        for k in range(1, n):
            if parent[k] == parent[top] and k != top and not gone[k] and top:
                good = final.get(k, 0.0) >= max(3.0, 0.2 * final[best]) or tag[k] == "h1"
                if not good and tag[k] == "p" and k in points:
                    good = density(k) < 0.25 and length[k] > 80
                if good:
                    roots.add(k)
        for k in range(n):
            self.kept[k] = (k in roots or k > 0 and self.kept[parent[k]]) and not gone[k]
        for k in range(1, n):  # headings under a dropped header
            if kept_heads[k]:
                self.kept[k] = any(a in roots for a in self._ancestors(k))
        return self.text()

    def _ancestors(self, k: int) -> Iterator[int]:
        while k >= 0:
            yield k
            k = self.parent[k]

    @staticmethod
    def _points(text: str) -> float:
        """One for a paragraph, one for each comma, up to three for length; a fragment counts little."""
        if len(text) < 25:
            return 0.1
        return 1 + sum(map(text.count, ",،、，")) + min(3.0, len(text) / 100)


def _words(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden. Names count whole (``data-id`` is no ``id``), and
    what stands within the value of another attribute counts nothing."""
    words: set[str] = set()
    hidden = False
    if "=" not in attributes and "hidden" not in attributes.lower():
        return words, hidden
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            words.update(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
        elif name == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
    return words, hidden


def main_text(html: str | None) -> str:
    return Page(html).extract() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but ``html``, and ``text`` (the main text; empty where there is none, or for a null or empty page) and
    ``n_chars`` (its code points). Columns of these names in ``pages`` are replaced."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pages.select(*kept).dtypes), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(kept))]
            arrays = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)
