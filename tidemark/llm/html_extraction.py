"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block elements. A logistic classifier, trained on labelled layouts, gives each block the
chance of being content from its words, links and sentences and from the elements and names around it. The negative
logarithms of that chance and of its opposite are the capacities to the terminals. Neighbours in page order and
neighbours under one parent are joined by edges that weaken with their distance in the document tree; their strength is
the one that gets most pages right of layouts that the classifier did not see. The minimum cut between the terminals is the labelling
of least total cost: it takes in the short paragraphs of an article and leaves out wordy furniture.

Reading, blocks and cut take time in proportion to the page, however deep or broken its markup is.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import html_layouts
from .common import map_rows, read
from .html_layouts import MARK

# Kinds of elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript head title svg annotation annotation-xml iframe object canvas audio video textarea select button option datalist".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
CONTENT_TAGS = frozenset("article main".split())
SCOPES = frozenset("ul ol dl table div section article main body aside nav footer form".split())
CLOSED_BY = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}  # an open one ends at the next

# The classifier's training and the range of its costs.
TRAINING_PAGES, TUNING_PAGES, SEED = 800, 300, 5
RIDGE = 0.1
SURE = 1e-4  # no chance is taken to be nearer to 0 or 1
STRENGTHS = (0.0, 0.25, 0.5, 0.75, 1.0)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
_QUOTE = re.compile("[\"']")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?…。](?=\s|$)")


@dataclass(eq=False)
class Element:
    tag: str
    up: Element | None
    depth: int = 0
    names: tuple[str, ...] = ()
    near: dict = field(default_factory=dict)  # kind -> innermost open element of that kind in this scope
    in_content: bool = False  # an article or main element here or above
    has_content: bool = False  # or below
    chars: int = 0  # of text in it
    signs: frozenset[str] | None = None


@dataclass(eq=False)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _open(tag: str, attrs: str, up: Element) -> tuple[Element, bool]:
    """The element and whether it shows no text."""
    silent = tag in SILENT_TAGS
    names: list[str] = []
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += [w.lower() for w in _NAME_WORD.findall(value)]
            elif key == "role":
                names.append("role=" + value.lower())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                silent = True
    near = up.near
    if tag in SCOPES:
        near = {}
    elif tag == "p" or tag in CLOSED_BY:
        near = dict(near)
    content = tag in CONTENT_TAGS
    found = Element(tag, up, up.depth + 1, tuple(names), near, content or up.in_content)
    if near is not up.near and tag not in SCOPES:
        near[CLOSED_BY.get(tag, tag)] = found
    if content:
        while up and not up.has_content:
            up.has_content = True
            up = up.up
    return found, silent


class _Scanner:
    """Where tags end. What is not there is looked for once: a page is read in linear time."""

    def __init__(self, page: str):
        self.page = page
        self.last_close = page.rfind(">")
        self.absent: set[str] = set()
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        """Like str.find, but what was not found is not there later either."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The > that ends the tag whose name ends at ``at``; those in quoted values do not."""
        page, first = self.page, self.find(">", at)
        if first < 0 or not self.quotes:
            return first
        end = first
        while True:
            found = _QUOTE.search(page, at, end)
            if not found:
                return end
            quote = found.start()
            before = quote - 1
            while before >= at and page[before] in " \t\n\r\f":
                before -= 1
            if before < at or page[before] != "=":
                at = quote + 1
                continue
            close = self.find(page[quote], quote + 1)
            if close >= 0:
                at = close + 1
                end = self.find(">", at) if at > end else end
            if close < 0 or end < 0:  # the quote does not end: from here on none counts
                self.quotes = False
                self.absent.discard(">")
                return first


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, without those that show nothing."""
    root = Element("", None)
    now, blocks, links = root, [Block(root)], 0
    elements = [root]
    opened: dict[str, int] = {}  # open elements per tag
    quiet: Element | None = None  # outermost silent element around
    scan = _Scanner(page)

    def say(text: str) -> None:
        if quiet is None and text:
            text = html.unescape(text)
            blocks[-1].parts.append(text)
            if links:
                blocks[-1].link_chars += len(text.strip())

    def cut() -> None:
        if blocks[-1].parts:
            blocks.append(Block(now))
        else:
            blocks[-1].element = now

    def leave(last: Element) -> None:
        """Closes elements up to ``last`` and that too."""
        nonlocal now, quiet
        while True:
            opened[now.tag] -= 1
            if now is quiet:
                quiet = None
            done, now = now is last, now.up
            if done:
                return

    at, n, said = 0, len(page), 0  # page[said:at] is text not yet passed on
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > scan.last_close:
            break
        at = start + 1
        head = page[at : at + 1]
        if head == "!" or head == "?":
            say(page[said:start])
            if page.startswith("!--", at):
                end = scan.find("-->", at + 3)
                said = at = n if end < 0 else end + 3
            elif page.startswith("![CDATA[", at) and (end := scan.find("]]>", at)) >= 0:
                say(page[at + 8 : end])
                said = at = end + 3
            else:
                end = scan.find(">", at)
                said = at = n if end < 0 else end + 1
            continue
        closing = head == "/"
        name = _NAME.match(page, at + closing)
        if not name:
            if closing and (end := scan.find(">", at)) >= 0:
                say(page[said:start])
                said = at = end + 1
            continue
        end = scan.tag_end(name.end())
        if end < 0:
            break
        say(page[said:start])
        attrs = page[name.end() : end]
        said = at = end + 1
        tag = name[0].lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                last = now
                while last.tag != tag:
                    last = last.up
                leave(last)
            if tag in BLOCK_TAGS:
                cut()
            elif tag == "br":
                say(" ")
        elif tag in VOID_TAGS:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                cut()
        else:
            kind = CLOSED_BY.get(tag)
            if kind or tag in BLOCK_TAGS:  # an open paragraph ends here, and a list item at the next one
                ends = now.near.get(kind) or now.near.get("p")
                if ends:
                    leave(ends)
            now, silent = _open(tag, attrs, now)
            elements.append(now)
            opened[tag] = opened.get(tag, 0) + 1
            if tag == "a":
                links += 1
            if silent and quiet is None:
                quiet = now
            if tag in BLOCK_TAGS:
                cut()
                links = 0 if tag != "li" else links
            if tag in RAW_TAGS and not attrs.endswith("/"):
                close = None if tag in scan.absent else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if not close:
                    scan.absent.add(tag)
                said = at = close.start() if close else n
    say(page[said:])
    kept = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
            b.element.chars += len(b.text)
    for e in reversed(elements):
        if e.up:
            e.up.chars += e.chars
    return kept


def _signs(e: Element, total: int, known) -> frozenset[str]:
    """What the elements from the root to ``e`` say: tags, and names, which are marked where they wrap most of the page
    or stand inside an article. Only signs in ``known`` (None: all) count, so the sets stay small."""
    way = []
    while e.signs is None and e.up:
        way.append(e)
        e = e.up
    signs = e.signs or frozenset()
    for e in reversed(way):
        wraps = e.has_content or e.chars > 0.6 * total
        inside = bool(e.up and e.up.in_content)
        place = "wraps:" if wraps else "in:" if inside else ""
        new = {f"{place}<{e.tag}>", *(place + w for w in e.names)}
        new = new - signs if known is None else {s for s in new if s in known and s not in signs}
        signs = signs | new if new else signs
        e.signs = signs
    return signs


def features(b: Block, total: int, known=None) -> dict[str, float]:
    """Signs of one block, 1 if there, and its measures. ``total``: characters of text on the page."""
    text, n = b.text, b.text.count(" ") + 1
    linked = min(1.0, b.link_chars / len(text))
    found = dict.fromkeys(_signs(b.element, total, known), 1.0)
    stops = len(_SENTENCE.findall(text))
    found |= {
        "1": 1.0, "words": min(np.log2(n), 7.0), "few words": float(n < 4), "linked": linked, "all linked": float(linked > 0.8),
        "unlinked words": min(np.log2(n), 7.0) * (1 - linked), "ends": float(text[-1] in ".!?…。:\"”"), "stops": min(stops, 6) / 6,
        "commas": min(1.0, 10 * text.count(",") / len(text)), "copyright": float("©" in text), f"own <{b.element.tag}>": 1.0,
        "list of links": float(linked > 0.5 and b.element.tag == "li"),
    }
    return found


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks, next to each other or next under one parent, with weights of 1 at most."""
    edges, last_under = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 2.0 ** -max(0, _distance(blocks[i - 1].element, b.element) - 2)))
        parent = id(b.element.up or b.element)
        before = last_under.get(parent)
        if before is not None and before < i - 1:
            edges.append((before, i, 0.5))
        last_under[parent] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut; symmetric ``edges``.

    A node whose terminal outweighs all its edges is on that terminal's side in some minimum cut. Such nodes are fixed
    first, their edges becoming terminal capacity of their neighbours; maximum flow separates what is left.
    """
    n = len(source)
    excess = [s - t for s, t in zip(source, sink)]
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            around[a][b] = around[a].get(b, 0.0) + c
            around[b][a] = around[b].get(a, 0.0) + c
    pull = [sum(x.values()) for x in around]
    side: list[bool | None] = [None] * n
    ready = [i for i in range(n) if abs(excess[i]) >= pull[i]]
    while ready:
        i = ready.pop()
        if side[i] is not None:
            continue
        side[i] = excess[i] > 0
        for j, c in around[i].items():
            if side[j] is None:
                excess[j] += c if side[i] else -c
                pull[j] -= c
                if abs(excess[j]) >= pull[j] - 1e-12:
                    ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[i], place[j], c) for i in rest for j, c in around[i].items() if i < j and side[j] is None]
        for i, kept in zip(rest, _source_side([excess[i] for i in rest], inner)):
            side[i] = kept
    return side


def _source_side(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side after maximum flow (Dinic's algorithm); positive excess comes from the source."""
    n = len(excess)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(excess):
        if x > 0:
            edge(s, i, x, 0.0)
        elif x < 0:
            edge(i, t, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        while True:  # paths of this level graph, without recursion
            path, a = [], s
            while a != t:
                while turn[a] < len(out[a]):
                    k = out[a][turn[a]]
                    if room[k] > tiny and level[to[k]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(out[a]):
                    path.append(out[a][turn[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break
            if a != t:
                break
            flow = min(room[k] for k in path)
            for k in path:
                room[k] -= flow
                room[k ^ 1] += flow


@dataclass
class BlockModel:
    weights: dict[str, float]
    strength: float  # of the edges

    def chances(self, blocks: list[Block]) -> list[float]:
        """Each block's chance of being content."""
        total = sum(len(b.text) for b in blocks)
        get = self.weights.get
        z = np.array([sum(get(f, 0.0) * x for f, x in features(b, total, self.weights).items()) for b in blocks])
        return np.clip(1 / (1 + np.exp(-np.clip(z, -50, 50))), SURE, 1 - SURE).tolist()

    def label(self, blocks: list[Block]) -> list[bool]:
        if not blocks:
            return []
        return _labels(self.chances(blocks), neighbours(blocks), self.strength)


def _labels(chances: list[float], edges: list[tuple[int, int, float]], strength: float) -> list[bool]:
    p = np.array(chances)
    return minimum_cut((-np.log1p(-p)).tolist(), (-np.log(p)).tolist(), [(a, b, c * strength) for a, b, c in edges])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of least logistic loss with a ridge penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_blocks(pages: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Blocks of training pages, and whether each is content; the marks are taken out."""
    out = []
    for page in pages:
        blocks = blocks_of(page)
        truth = [MARK in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "x"
        out.append((blocks, truth))
    return out


@lru_cache(maxsize=1)
def block_model() -> BlockModel:
    """Trained on made layouts, which are bounded and the same at every call; once in a driver process."""
    train = labelled_blocks(html_layouts.training_pages(TRAINING_PAGES, SEED))
    rows, y = [], []
    for blocks, truth in train:
        total = sum(len(b.text) for b in blocks)
        rows += [features(b, total) for b in blocks]
        y += truth
    seen: dict[str, int] = {}
    for r in rows:
        for f in r:
            seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, k in seen.items() if k >= 10)
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for f, value in r.items():
            if f in place:
                x[i, place[f]] = value
    model = BlockModel(dict(zip(names, _logistic(x, np.array(y, float), RIDGE).tolist())), 0.0)
    tune = labelled_blocks(html_layouts.training_pages(TUNING_PAGES, SEED + 1))
    judged = [(model.chances(blocks), neighbours(blocks), truth) for blocks, truth in tune if blocks]
    wrong = [sum(_labels(p, edges, strength) != truth for p, edges, truth in judged) for strength in STRENGTHS]  # pages
    model.strength = STRENGTHS[int(np.argmin(wrong))]
    return model


def extract(page: str | None, model: BlockModel | None = None) -> str:
    """The main text: content blocks in page order, one a line."""
    blocks = blocks_of(page) if page else []
    keep = (model or block_model()).label(blocks)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text string and n_chars for every row of ``pages`` (html), from the whole page.

    Null and empty pages, and pages without content: the empty text. Repeated rows stay, empty tables give none, other
    columns are dropped.
    """
    model = block_model()  # a few hundred weights, sent with the task

    def make():
        def run(pages):
            texts = [extract(p, model) for p in pages]
            return texts, list(map(len, texts))

        return run

    return map_rows(pages, keep, ("html",), make, "text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
