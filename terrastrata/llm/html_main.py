"""HTML main text by gradient-boosted trees over DOM nodes.

Each element of a page gets features: its text and link density and those of its subtree, tokens of its
tag, class, id and role, its depth and its siblings. Boosted trees, fitted here on generated pages of
known layout, give every element the odds of being main content. Decoding then labels the whole tree at
once: an element is outside, inside or removed; what is removed stays removed below, and inside begins
once on a path, so that no element contradicts its ancestors. The likeliest consistent labelling wins.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Pages generated to fit the trees on, and the trees' number, depth, bins and step.
FIT_PAGES, TREES, DEPTH, BINS, STEP = 600, 40, 4, 24, 0.3
#: Log-odds that a change from outside to inside, or from inside to removed, must be worth.
ENTER, LEAVE = 2.0, 1.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and no text of the page; only these two swallow the rest of a page that doesn't close them.
RAW, SWALLOW = frozenset("script style iframe textarea title".split()), frozenset("script style".split())
#: Elements whose text is never content: parts of forms, and what isn't shown.
DROPPED = frozenset("button select option optgroup datalist template".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Items that only border lines of their list or row; controls; elements of running text.
LINES, CONTROLS = frozenset("li tr dt dd tbody thead tfoot".split()), frozenset("form input fieldset".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: An open element of these ends where one of its tags begins.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
}
for _tag in ("button", "select", "option", "optgroup"):  # unclosed, they must not take in what follows
    CLOSES[_tag] = CLOSES.get(_tag, frozenset()) | CLOSES["p"]
#: Tokens in tags, classes, ids and roles that speak for and against main content.
GOOD = re.compile(r"article|\bmain\b|content|\bpost\b|entry|story|\bbody\b|text|prose")
BAD = re.compile(
    r"nav|menu|header|footer|sidebar|aside|\bads?\b|advert|promo|sponsor|banner|cookie|consent|notice|popup|modal|form|"
    r"search|login|subscribe|newsletter|share|social|related|recommend|breadcrumb|pagination|pager|widget|comment|reply|"
    r"disqus|tags|copyright|toolbar|skip|alert|gdpr|signup|complementary|contentinfo"
)
#: Of inline elements and list items, which are nodes only if named like this.
PAID = re.compile(r"\bads?\b|advert|promo|sponsor|banner|cookie|consent|newsletter|subscribe|share|social|related|recommend")
COMMENT = re.compile(r"comment|reply|replies|disqus|discuss|respond")
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element; ``parts`` are its texts, children and borders of lines (None) in page order.

    Inline elements and items of lists and rows are no nodes of their own, unless named like an advert: their
    text is their parent's, which counts the characters within links. ``nested`` counts open plain elements
    of a node's own tag within it.
    """

    __slots__ = ("tag", "attrs", "parent", "depth", "parts", "nth", "place", "chars", "linked", "stops", "items", "controls", "children", "nested")

    def __init__(self, tag: str, attrs: str, parent: Node | None, place: int) -> None:
        self.tag, self.attrs, self.parent, self.place, self.parts = tag, attrs, parent, place, []
        self.depth, self.nth = (parent.depth + 1, parent.children) if parent else (0, 0)
        self.chars = self.linked = self.stops = self.items = self.controls = self.children = self.nested = 0

    def say(self, text: str, linked: bool) -> None:
        if "&" in text:
            text = unescape(text)
        self.parts.append(text)
        n = len(text)
        if linked:
            self.linked += n
        self.chars += n if n > 40 else len(text.strip())
        self.stops += text.count(".") + text.count(",")


_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def names_of(attrs: str) -> str:
    """The class, id and role of an element, in lower case with hyphens."""
    return " ".join(_CAMEL.sub("-", a or b or c) for a, b, c in _NAMED.findall(attrs)).lower().replace("_", "-") if attrs else ""


def parse(html: str) -> list[Node]:
    """The elements of a page in page order, the root first; any text is a tree of some kind."""
    root = Node("html", "", None, 0)
    nodes, here, at, links = [root], root, 0, 0
    opened: dict[str, list[Node]] = defaultdict(list)  # by tag, so that no end tag searches a deep page in vain
    endless: set[str] = set()  # raw elements without an end tag in the rest of the page

    def shut(last: Node) -> Node:
        x = here
        while x is not last.parent:
            opened[x.tag].pop()
            x = x.parent
        return last.parent

    def begin(tag: str, names: str) -> Node:
        child = Node(tag, names, here, len(nodes))
        here.children += 1
        here.parts.append(child)
        nodes.append(child)
        return child

    def line_of(tag: str) -> Node | None:
        """The open item of this tag in the list or table at hand."""
        last = opened[tag][-1] if opened[tag] else None
        x = here
        while last is not None and x is not last:
            if x.tag in ("ul", "ol", "dl", "table"):
                return None
            x = x.parent
        return last

    for m in _MARKUP.finditer(html):
        start = m.start()
        if start < at:
            continue
        if start > at:
            here.say(html[at:start], links > 0)
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            own = opened[tag]
            if m[1]:
                if own and own[-1].nested:
                    own[-1].nested -= 1
                elif own:
                    here = shut(own[-1])
            elif m[3] and not m[3].endswith("/") and PAID.search(names := names_of(m[3])):
                here = begin(tag, names)
                own.append(here)
            elif own:
                own[-1].nested += 1
            continue
        if tag == "br":
            here.parts.append(" ")
            continue
        if tag in LINES:
            if line := line_of(tag):
                here = shut(line)
            here.parts.append(None)
            here.items += not m[1]
            if not m[1] and m[3] and PAID.search(names := names_of(m[3])):
                here = begin(tag, names)
                opened[tag].append(here)
            continue
        links = 0
        if m[1]:
            if opened[tag]:
                here = shut(opened[tag][-1])
            continue
        if tag == "html" or tag == "body":
            continue
        if tag in RAW:
            end = None if tag in endless else _ENDS[tag].search(html, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (len(html) if tag in SWALLOW else at)
            continue  # nothing in it is text
        up = here
        while up.tag in CLOSES or up.tag in INLINE:  # an open paragraph, cell or control ends where a block begins
            if up.tag in CLOSES and tag in CLOSES[up.tag]:
                here = shut(up)
            up = up.parent
        if tag in CONTROLS:
            here.controls += 1
        if tag in VOID:
            if tag == "hr":
                here.parts.append(None)
            continue
        attrs = m[3]
        child = begin(tag, names_of(attrs))
        if not attrs.endswith("/"):
            here = child
            opened[tag].append(child)
    if at < len(html):
        here.say(html[at:], links > 0)
    return nodes


def features(nodes: list[Node]) -> list[tuple]:
    """One row per element: its text and that of its subtree, attribute tokens, depth, siblings."""
    n = len(nodes)
    chars, linked, stops = [x.chars for x in nodes], [x.linked for x in nodes], [x.stops for x in nodes]
    items, controls, blocks = [x.items for x in nodes], [x.controls for x in nodes], [0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        up = nodes[i].parent.place
        chars[up] += chars[i]
        linked[up] += linked[i]
        stops[up] += stops[i]
        items[up] += items[i]
        controls[up] += controls[i]
        blocks[up] += blocks[i] + (nodes[i].tag in TEXTUAL)
    total = max(chars[0], 1)
    own: list[tuple[bool, bool, bool]] = []
    above: list[tuple[bool, bool, bool]] = []
    rows = []
    for i, x in enumerate(nodes):
        tag, up = x.tag, x.parent.place if x.parent is not None else 0
        if x.attrs or tag not in TEXTUAL:
            said = f"{tag} {x.attrs}"
            marks = GOOD.search(said) is not None, BAD.search(said) is not None, COMMENT.search(said) is not None
        else:
            marks = False, False, False
        own.append(marks)
        a, o = (above[up], own[up]) if i else ((False,) * 3, (False,) * 3)
        over = a[0] or o[0], a[1] or o[1], a[2] or o[2]
        above.append(over)
        inner, outer = max(chars[i], 1), max(chars[up], 1)
        rows.append(
            (
                min(chars[i], 5000), chars[i] / total, linked[i] / inner, blocks[i], items[i], controls[i], stops[i] / inner, *marks, *over,
                x.depth, x.nth, tag in ("article", "main"), tag in ("nav", "aside", "footer", "header", "form"), tag in TEXTUAL,
                tag in ("ul", "ol", "dl", "table"), tag[0] == "h" and len(tag) == 2, chars[i] / outer, linked[up] / outer, x.children, len(x.attrs) > 0,
            )
        )
    return rows


class Boosted:
    """Gradient-boosted regression trees for a binary label, with binned features and logistic loss."""

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            slope, bend = p - y, p * (1 - p)
            size = 2 ** (DEPTH + 1) - 1
            feature, cut_at, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), int)
            for k in range(size):
                here = np.flatnonzero(node == k)
                if not len(here):
                    continue
                g, h = slope[here].sum(), bend[here].sum()
                value[k] = -STEP * g / (h + 1.0)
                if k >= 2**DEPTH - 1:
                    continue
                best = (1e-3, -1, 0)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gs = np.bincount(binned[here, f], slope[here], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(binned[here, f], bend[here], len(e) + 1).cumsum()[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), f, j)
                if best[1] >= 0:
                    feature[k], cut_at[k] = best[1], edges[best[1]][best[2]]
                    node[here] = 2 * k + 1 + (binned[here, best[1]] > best[2])
            self.trees.append((feature, cut_at, value))
            margin += value[node]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut_at, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > cut_at[node]))
            out += value[node]
        return out


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Which elements are inside, by the likeliest consistent labelling of the tree."""
    n = len(nodes)
    inside = [min(max(float(o), -8.0), 8.0) for o in odds]  # against the element not being content
    outside, up = [0.0] * n, [x.parent.place if x.parent is not None else 0 for x in nodes]
    for i in range(n - 1, 0, -1):
        if nodes[i].tag not in DROPPED:
            outside[up[i]] += max(outside[i], inside[i] - ENTER)
            inside[up[i]] += max(inside[i], -LEAVE)
    out, removed = [False] * n, [x.tag in DROPPED for x in nodes]
    out[0] = inside[0] - ENTER > outside[0]
    for i in range(1, n):
        if removed[i]:
            continue
        if out[up[i]]:
            out[i] = inside[i] >= -LEAVE
            removed[i] = not out[i]
        elif removed[up[i]]:
            removed[i] = True
        else:
            out[i] = inside[i] - ENTER > outside[i]
    return out


def text_of(nodes: list[Node], inside: list[bool]) -> str:
    """The text of the elements inside: white space within a block is one blank, blocks too are joined by one."""
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = [nodes[0]]
    while todo:  # a stack, as pages may nest deeply; None is the border of a block
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        else:
            parts = x.parts if inside[x.place] else [p for p in x.parts if isinstance(p, Node)]
            border = [] if x.tag in INLINE else [None]
            todo.extend(border)
            todo.extend(reversed(parts))
            todo.extend(border)
    return " ".join(t for b in blocks if (t := " ".join("".join(b).split())))


def _words(rng: random.Random, n: int) -> str:
    syllables = "ka to mi re lu so ne va di pe ro sa li mo te".split()
    each = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    style = rng.random()
    if style < 0.12:  # without stops; with symbols; all in capitals
        return " ".join(each)
    if style < 0.2:
        return " ".join(w + rng.choice(("###", "***", "$$$", " |", "%%%")) for w in each)
    if style < 0.26:
        return " ".join(each).upper() + "!!"
    ends = ["," if rng.random() < 0.08 else "." if rng.random() < 0.1 else "" for _ in each]
    return " ".join(w + e for w, e in zip(each, ends)).capitalize() + "."


def training_page(rng: random.Random) -> str:
    """A generated page; elements of its main text carry the attribute token ``zz``."""
    w = lambda a, b: _words(rng, rng.randint(a, b))
    link = lambda a=1, b=3: f'<a href="/x">{w(a, b)[:-1]}</a>'

    def menu(tag: str, name: str) -> str:
        return f"<{tag}{name}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + f"</ul></{tag}>"

    def junk() -> str:
        kind = rng.randint(0, 11)
        name = lambda *x: f' {rng.choice(("class", "id"))}="{rng.choice(x)}"'
        return (
            lambda: menu("nav", ""),
            lambda: menu("div", name("menu", "top-nav", "navbar", "main-menu", "breadcrumb", "pagination")),
            lambda: f"<header>{link()}<p>{w(2, 8)}</p></header>",
            lambda: f"<footer>&copy; {w(1, 4)} &middot; {w(4, 25)}{'<p>' + link() + '</p>' if rng.random() < 0.4 else ''}</footer>",
            lambda: f"<aside>{'<h3>' + w(1, 3) + '</h3>' if rng.random() < 0.5 else ''}<p>{w(5, 40)}</p>{link()}</aside>",
            lambda: f"<div{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-banner')}>{w(3, 40)}</div>",
            lambda: f"<div{name('cookie-notice', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'popup')}><p>{w(6, 40)}</p><button>OK</button></div>",
            lambda: f"<form{name('search', 'login', 'newsletter', 'f')}><label>{w(1, 4)}</label><input name=q><p>{w(2, 15)}</p></form>",
            lambda: f"<{(t := rng.choice(('section', 'div')))}{name('comments', 'comment-list', 'replies', 'disqus')}><h2>{w(1, 2)}</h2>"
            + "".join(f"<div{name('comment', 'reply')}><b>{w(1, 2)}</b><p>{w(4, 60)}</p></div>" for _ in range(rng.randint(1, 5))) + f"</{t}>",
            lambda: f"<div{name('related', 'share', 'social', 'recommended', 'tags', 'widget')}>" + "".join(link(2, 8) for _ in range(rng.randint(2, 6))) + "</div>",
            lambda: f"<div{name('sidebar', 'side', 'sidebar-right')}><h3>{w(1, 3)}</h3><p>{w(4, 50)}</p><ul><li>{link(2, 6)}</li><li>{link(2, 6)}</li></ul></div>",
            lambda: f"<{(t := rng.choice(('section', 'div', 'ol')))}{name('comments', 'user-comments', 'reader-comments')}>"
            + "".join(f"<article class=\"comment\"><p>{w(4, 80)}</p></article>" for _ in range(rng.randint(1, 4))) + f"</{t}>",
        )[kind]()

    def paid(tag: str) -> str:
        return f'<{tag} class="{rng.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-banner", "newsletter", "share", "social", "related"))}">{w(1, 8)}</{tag}>'

    def block() -> str:
        z = ' class="zz"'
        r = rng.random()
        if r < 0.68:
            inner = w(1, 4) if rng.random() < 0.2 else w(8, 110)
            if rng.random() < 0.25:
                inner += f' <a{z} href="/y">{w(1, 4)}</a> {w(2, 12)}'
            if rng.random() < 0.06:
                inner += paid(rng.choice(("span", "em", "a")))
            if rng.random() < 0.15:
                inner = f"<b{z}>{inner}<br>" if rng.random() < 0.5 else f"<b{z}>{w(1, 6)}</b> {inner}"
            return f"<p{z}>{inner}" + ("</p>" if rng.random() < 0.85 else "")
        if r < 0.8:
            return f"<h2{z}>{w(1, 9)}</h2>"
        if r < 0.9:
            t = rng.choice(("ul", "ol"))
            lines = [f"<li{z}>{w(2, 25)}</li>" for _ in range(rng.randint(1, 7))]
            if rng.random() < 0.15:
                lines.insert(rng.randint(0, len(lines)), paid("li"))
            return f"<{t}{z}>" + "".join(lines) + f"</{t}>"
        if r < 0.95:
            return f"<blockquote{z}><p{z}>{w(5, 40)}</p></blockquote>"
        if r < 0.98:
            return f"<table{z}>" + "".join(f"<tr{z}><td{z}>{w(1, 3)}</td><td{z}>{w(1, 4)}</td></tr>" for _ in range(rng.randint(1, 6))) + "</table>"
        return f"<pre{z}>{w(5, 60)}</pre>"

    title = w(1, 14)[: rng.choice((60, 200))]
    head = f"<head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    parts = [f'<h1 class="zz">{title}</h1>'] if rng.random() < 0.9 else []
    parts += [block() for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6, 10, 16)))] or [f'<p class="zz">{w(10, 120)}</p>'] * (not parts)
    if rng.random() < 0.3:
        parts.insert(rng.randint(0, len(parts)), junk())
    body = "".join(parts)
    opening = rng.choice(
        ("article", "article", "article", "main", "div-content", "div-post", "div-article-body", "div-entry-content", "section-story", "div-main", "div")
    )
    tag, _, name = opening.partition("-")
    core = f'<{tag} class="zz {name}">{body}</{tag}>'
    if rng.random() < 0.3:
        core = f"<{rng.choice(('main', 'div', 'div class=wrapper', 'div id=page'))}>{junk() if rng.random() < 0.5 else ''}{core}{junk() if rng.random() < 0.6 else ''}</div></main>"
    before = "".join(junk() for _ in range(rng.randint(0, 4)))
    after = "".join(junk() for _ in range(rng.randint(0, 4)))
    tail = "</body></html>" if rng.random() < 0.8 else ""
    return f"<!DOCTYPE html><html>{head}<body>{before}{core}{after}{tail}"


def unmark(nodes: list[Node]) -> list[bool]:
    """Take the marks of generated pages off their elements."""
    marks = []
    for x in nodes:
        names = x.attrs.split()
        marks.append("zz" in names)
        x.attrs = " ".join(n for n in names if n != "zz")
    return marks


def fit(pages: int = FIT_PAGES, seed: int = 7) -> Boosted:
    """Trees fitted on ``pages`` generated pages; the same for the same arguments."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(rng))
        ys += unmark(nodes)
        xs += features(nodes)
    return Boosted().fit(np.array(xs, float), np.array(ys, float))


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """The main text of each page; the trees score the elements of them all at once."""
    parsed = [parse(h) if h else [] for h in pages]
    rows = [r for nodes in parsed if nodes for r in features(nodes)]
    odds = trees.margins(np.array(rows, float)).tolist() if rows else []
    texts, at = [], 0
    for nodes in parsed:
        texts.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])) if nodes else "")
        at += len(nodes)
    return texts


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id_col``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    The whole html is read; null or empty html, and pages without main text, give an empty text.
    Repeated rows give equal results; null ids and urls pass through; extra columns are ignored; an
    empty table gives no rows.
    """
    trees = fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            html, texts = batch["html"].tolist(), []
            for i in range(0, len(html), 200):  # few trees of elements in memory at a time
                texts += main_texts(html[i : i + 200], trees)
            out = batch[[id_col, "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    schema = T.StructType([pages.schema[id_col], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, "url", "html").mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract every page."""
    return extract(table(spark, sf_dir, "pages"))


#: For pages of one layout, whose main text is an article element: what extraction must give.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS text FROM a
), d AS (
  SELECT page_id, url, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM t
), s AS (SELECT page_id, url, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s
"""
