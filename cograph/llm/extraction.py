"""Operator 4, main text of web pages by minimum-cut labelling.

A page becomes text blocks with their place in the element tree. Each block's log odds of being content,
from a logistic classifier over text statistics and, moderately, from what its enclosing elements say, are its terminal capacity (to the
content terminal if positive, to the boilerplate terminal if negative). Regions that are boilerplate by what they are (menus,
headers, footers, sidebars, comments, notices, adverts) have a terminal capacity that no text outweighs; only an article or ``main``
inside leaves them, and a region that is so by a class name only says nothing if it holds the page's title. Neighbouring blocks, and blocks that
follow each other under one element, are tied by smoothness edges, weaker with tree distance. The minimum cut
labels the blocks. The network is first reduced without changing any cut: blocks whose capacity outweighs all their edges are
decided, blocks with two neighbours or fewer are replaced by the capacities that they can pass on, which takes linear time on the
chains and nested followers of a page; maximum flow is run on what is left. Pages are worked on one by one inside tasks, whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Element names and words of class, id and role attributes.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|audio|video|select"
DROPPED = {"head", "button", "fieldset", "dialog", "input", "label", "legend", "datalist", "output", "progress", "meter"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILERPLATE = {"nav", "footer", "aside", "menu"}
CONTENT = {"article", "main"}
BAD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets", "complementary", "contentinfo", "alert", "header"}
APART = {"comment", "comments", "disqus", "recommended", "related", "replies", "respond"}  # an article among these is another one
GOOD_WORDS = {"article", "content", "entry", "main", "post", "story", "articlebody", "body", "text"}
# Words that make an element boilerplate whatever its text, and words of a class name that take that back.
FIRM_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "reply", "respond", "search", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar"}
STATE_WORDS = {"category", "closed", "content", "disabled", "enabled", "format", "free", "has", "hide", "is", "no", "not", "off", "on", "open", "show", "status", "tag", "tagged", "type", "with", "without"}
PAGE_PARTS = {"article", "main", "nav", "footer", "aside"}  # a form that holds one of these is the page's

_ATTRS = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(" + RAW + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + _ATTRS + r")>|</?[a-zA-Z].*\Z|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MAYBE_HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HINT = 1.5  # what an enclosing element says, in log odds: less than the text (LIMIT) and two strong ties can say
LIMIT = 3.0  # what the text says, at most
FIRM = 20.0  # what a region that is boilerplate by what it is says: more than text, hints and all ties together
TIES = (0.8, 0.4)  # smoothness: neighbours in the page, followers under one element


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    depth: int  # open elements
    common: int  # of these, those open since the block before
    parent: int  # number of the element around the block's own
    says: int  # +1 content, -1 boilerplate, 0 nothing
    firm: bool  # whether no text outweighs that


class Region:
    """An element whose meaning is known only after its end: a form, or one that is boilerplate by a class name."""

    def __init__(self, around: Region | None):
        self.around, self.titled, self.page_wide, self.prose, self.paragraphs = around, False, False, 0, 0


def _hidden(attrs: str) -> bool:
    """Whether an element is hidden by an attribute of its own: hidden, aria-hidden=true, style with display:none."""
    if not _MAYBE_HIDDEN.search(attrs):
        return False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NONE.search(value)):
            return True
    return False


def _says(name: str, attrs: str, inside: int) -> tuple[int | None, bool]:
    """What an element says about its blocks, given what encloses it, and whether it says so by a class name that
    makes it firm. None: nothing in it is text. -3 is firm boilerplate that only ``main`` leaves, -2 firm and -1 moderate
    boilerplate that an article leaves too, 0 nothing, 1 content."""
    if name in DROPPED or (attrs and _hidden(attrs)):
        return None, False
    if name in BOILERPLATE:
        return -3, False
    tokens = _names(attrs) if attrs and name not in ("html", "body") else []
    told = [t for t in tokens if not t & STATE_WORDS]
    if name in CONTENT:
        if any(t & APART for t in told) or (inside == -3 and name != "main"):
            return -3, False
        return (-1 if inside >= 0 and any(len(t) == 1 and t & BAD_WORDS for t in told) else 1), False
    if inside == -3:
        return -3, False
    words = {w for t in told for w in t}
    firm = words & FIRM_WORDS
    if firm & APART:
        return -3, False
    if firm:
        return -2, True
    if name == "header" and inside <= 0:
        return -2, False
    if inside < 0:
        return inside, False
    if inside > 0:
        words -= {"header", "tags", "text"}
    if words & BAD_WORDS:
        return -1, False
    return (1 if any(t & GOOD_WORDS for t in tokens) else inside), False


def _names(attrs: str) -> list[set[str]]:
    """The words of each name in the class, id and role attributes."""
    found = [m for m in _ATTRIBUTE.finditer(attrs) if m[1].lower() in ("class", "id", "role")]
    return [{w.lower() for w in _WORD.findall(token)} for m in found for token in entities.unescape(m[2] or m[3] or m[4] or "").split()]


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in page order; unclosed, misnested and cut-off markup is taken as browsers do, roughly.
    Forms are left out but those that span the page: they hold one of its parts, or most of its prose in three paragraphs or more."""
    out: list[tuple[Block, Region | None, Region | None]] = []
    # name, says, element number, region by a class name, form
    stack: list[tuple[str, int | None, int, Region | None, Region | None]] = [("", 0, 0, None, None)]
    opened: Counter[str] = Counter()
    forms: list[Region] = []
    number, parts, linked, in_link, low, prose = 0, [], 0, False, 1, 0

    def close() -> None:
        nonlocal parts, linked, in_link, low, prose
        text = " ".join("".join(parts).split())
        name, says, _, named, form = stack[-1]
        if text and says is not None:
            block = Block(text, min(linked, len(text)), name, len(stack), low, stack[-2][2] if len(stack) > 1 else 0, max(-1, says), says < -1)
            out.append((block, named if says == -2 else None, form))
            low = len(stack)
            if name == "p" and not block.firm:
                plain = len(text) - block.linked
                prose += plain
                if form:
                    form.prose += plain
                    form.paragraphs += 1
        parts, linked, in_link = [], 0, False

    def leave(size: int) -> None:
        nonlocal low
        opened.subtract(e[0] for e in stack[size:])
        del stack[size:]
        low = min(low, size)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = entities.unescape(page[at : m.start()])
            parts.append(text)
            linked += len(text) * in_link
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        ends, attrs = bool(m[2]), m[4] or ""
        if name in INLINE:
            if name == "a":
                in_link = not ends
            hidden = False if ends or not attrs else _hidden(attrs) and name not in VOID
            if not hidden and not opened[name]:
                continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        if ends:
            if opened[name] > 0:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
        elif name not in VOID:
            if stack[-1][0] == "p" and name not in INLINE or (name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name):
                leave(len(stack) - 1)
            number += 1
            _, inside, _, named, form = stack[-1]
            says, by_name = (None, False) if inside is None else _says(name, attrs, inside)
            if by_name:
                named = Region(named)
            if says is not None:
                if name == "h1":
                    region = named
                    while region and not region.titled:
                        region.titled, region = True, region.around
                region = form if name in PAGE_PARTS else None
                while region and not region.page_wide:
                    region.page_wide, region = True, region.around
            if name == "form":
                form = Region(form)
                forms.append(form)
            opened[name] += 1
            stack.append((name, says, number, named, form))
    if at < len(page):
        parts.append(entities.unescape(page[at:]))
    close()
    for form in reversed(forms):  # inner forms come after the ones around them
        if form.around:
            form.around.prose += form.prose
            form.around.paragraphs += form.paragraphs
    dropped: set[Region] = set()
    for form in forms:
        if form.around in dropped or not (form.page_wide or (form.paragraphs >= 3 and 2 * form.prose > prose)):
            dropped.add(form)
    found: list[Block] = []
    low = len(page) + 1
    for block, named, form in out:
        low = min(low, block.common)
        if form not in dropped:
            block.common, low = low, len(page) + 1
            if named and named.titled:
                block.says, block.firm = 0, False
            found.append(block)
    return found


def measures(b: Block) -> list[float]:
    """Text statistics of a block for the classifier."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [1.0, np.log1p(words), b.linked / n, min(1.0, sum(map(b.text.count, ".,;:!?")) / words), float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag == "li"), float("©" in b.text)]


#: Classifier used when no page of the sample tells content from boilerplate by its elements.
DEFAULT_WEIGHTS = (-2.0, 0.8, -4.0, 1.0, 0.5, 0.5, -1.0, -3.0)


def costs(page: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log odds of content of each block."""
    x = np.array([measures(b) for b in page])
    return np.clip(x @ weights, -LIMIT, LIMIT) + np.array([b.says * (FIRM if b.firm else HINT) for b in page])


def ties(page: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges (i < j): neighbours by tree distance, and followers under the same element."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for j, b in enumerate(page):
        if j:
            edges[j - 1, j] = TIES[0] / max(1, page[j - 1].depth + b.depth - 2 * b.common)
        if b.parent in last:
            key = (last[b.parent], j)
            edges[key] = edges.get(key, 0.0) + TIES[1]
        last[b.parent] = j
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the blocks on the content side of the least cut; a tie goes to boilerplate."""
    n = len(odds)
    odds, near = list(odds), [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a block whose own capacity outweighs its edges is on that side in every least cut
        i = queue.popleft()
        if side[i] is None and abs(odds[i]) > sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if side[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left: list[tuple[int, float, dict[int, float]]] = []  # blocks replaced by what they pass on between their neighbours
    gone = [x is not None for x in side]
    queue = deque(i for i in range(n) if not gone[i])
    while queue:
        v = queue.popleft()
        if gone[v] or len(near[v]) > 2:
            continue
        gone[v] = True
        left.append((v, odds[v], near[v]))
        (a, wa), (b, wb) = [*near[v].items(), (v, 0.0), (v, 0.0)][:2]
        none, one, other, both = (min(x * wa + y * wb, (1 - x) * wa + (1 - y) * wb - odds[v]) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)))
        tie = max(0.0, (one + other - none - both) / 2)  # the least cut around v as capacities of a, b and the edge a - b
        for i, gain in ((a, one - none - tie), (b, other - none - tie)):
            if i != v:
                odds[i] -= gain
                del near[i][v]
                queue.append(i)
        if a != v and b != v and tie > 0:
            near[a][b] = near[a].get(b, 0.0) + tie
            near[b][a] = near[b].get(a, 0.0) + tie
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        s, t = n, n + 1
        flow: list[dict[int, float]] = [{} if gone[i] else dict(near[i]) for i in range(n)] + [{}, {}]
        for i in rest:
            a, b = (s, i) if odds[i] > 0 else (i, t)
            flow[a][b] = abs(odds[i])
            flow[b].setdefault(a, 0.0)
        while True:  # shortest augmenting paths
            came, todo = {s: s}, deque([s])
            while todo and t not in came:
                u = todo.popleft()
                for v, c in flow[u].items():
                    if c > 1e-9 and v not in came:
                        came[v] = u
                        todo.append(v)
            if t not in came:
                break
            path, v = [], t
            while v != s:
                path.append((came[v], v))
                v = came[v]
            push = min(flow[u][v] for u, v in path)
            for u, v in path:
                flow[u][v] -= push
                flow[v][u] = flow[v].get(u, 0.0) + push
        for i in rest:
            side[i] = i in came
    for v, own, edges_of in reversed(left):
        here = sum(w if side[i] else 0.0 for i, w in edges_of.items())
        side[v] = 2 * here + own > sum(edges_of.values()) + 1e-9
    return [bool(x) for x in side]


def main_blocks(page: str | None, weights: np.ndarray) -> list[str]:
    found = blocks(page or "")
    if not found:
        return []
    return [b.text for b, content in zip(found, minimum_cut(costs(found, weights).tolist(), ties(found)), strict=True) if content]


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = 2_000, rounds: int = 200) -> np.ndarray:
    """Weights of the text classifier, fitted by logistic regression on the blocks of ``sample`` pages (one row for each of the
    smallest id hashes) whose elements say what they are; the fixed default weights if they tell nothing."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    ids = rows.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = rows.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("html").alias("html"))

    def measure(batches):
        for batch in batches:
            found = [b for page in batch.column(0) for b in blocks(page.as_py() or "") if b.says]
            yield pa.record_batch([pa.array([measures(b) for b in found], pa.list_(pa.float64())), pa.array([b.says for b in found], pa.int32())], names=["x", "y"])

    grouped = chosen.select("html").mapInArrow(measure, "x array<double>, y int").groupBy("x", "y").count().toArrow()
    y, n = np.array(grouped["y"].to_pylist()), np.array(grouped["count"].to_pylist(), float)
    default = np.array(DEFAULT_WEIGHTS)
    if len(set(y.tolist())) < 2:
        return default
    x = np.array(grouped["x"].to_pylist())
    order = np.lexsort(np.column_stack([y, x]).T)
    x, y, n = x[order], y[order], n[order]
    n = n / np.where(y > 0, n[y > 0].sum(), n[y < 0].sum())
    w = default.copy()
    for _ in range(rounds):  # Newton steps towards the default weights' neighbourhood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - (y > 0))) + 0.01 * (w - default)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def extract(pages: DataFrame, weights: np.ndarray | None = None, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """All rows and columns of ``pages`` plus ``text`` (main blocks in page order, joined by a space) and
    ``n_chars`` (its code points).

    Null or empty html, and pages without content, give the empty text; the whole page is read whatever its length; rows that
    repeat give equal texts; an empty table gives an empty result; input columns named ``text`` or ``n_chars`` are replaced.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(train(pages, html_col, id_col) if weights is None else weights)
    ship(spark)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([" ".join(main_blocks(page.as_py(), shared.value)) for page in column], pa.string())

    d = pages.drop(*({"text", "n_chars"} - {html_col, id_col})).withColumn("text", text(F.col(html_col)))
    return d.withColumn("n_chars", F.length("text").cast("long"))
