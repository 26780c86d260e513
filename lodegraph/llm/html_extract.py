"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (the text between the starts and ends of block elements). A classifier gives
every block log-odds of being content from what its text looks like and from one bounded feature of the
markup: what tags and class words around it hint (an article; a menu, advert, comment section...), nested
hints adding up to a bound, an inner one of the other kind replacing them. Words of a class name that say
what a wrapper has or is filed under (has-sidebar, category-social, tag-search, comments-open) are no hints.
The log-odds, cut at ``COST``, are the capacities between the block and the two terminals. Smoothness edges
join neighbours in page order, weaker with their distance in the tree, and neighbours under one parent;
where the markup hints differently at the two ends they are ``CONTRAST`` times as strong. Together they can
outweigh any block's own capacity, marked or not. The minimum cut, by maximum flow (Dinic's algorithm) over
all blocks of the page, is the labelling of least total cost. Blocks that aren't shown (hidden,
display:none) are bound to boilerplate.

The classifier is a logistic regression with a Gaussian prior around plain starting weights, fitted here on
blocks of a bounded sample of pages (about ``TRAIN_PAGES``) by co-training: the weights of the text's looks
on labels by the markup (inside an article or main element against inside menus, footers, asides and
forms), then the weight of the markup's hint on what the looks say. Reader comments, which read like
content, have no part in the second.

Text: character references decoded, white space inside a block one space, trimmed, empty blocks gone,
blocks joined by one line feed in page order. A line break element is white space; the cells of a table
row are one block. Nothing else is dropped or cut.

Null or empty html, and pages without content: empty text. Empty table: empty result. Repeated rows are
extracted each. Other columns are ignored. Broken markup never fails: what can't be read is text.

Scale: one pass without a shuffle; the model is a dozen numbers. Reading a page is linear in its length,
whatever is left open or unquoted in it, and so is what a block holds of its place in the tree.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 1500
#: How much of the outer hints of the markup is added to an inner one of their kind, and the bound of nested ones.
KEPT, HINTS = 0.5, 1.5
#: Bounds of the log-odds by the text's looks, and of a block's capacity in all.
LOOKS, COST = 4.0, 2.5
#: Capacity of what isn't shown at all: more than all edges of a block.
HIDDEN = 12.0
ADJACENT, SIBLING, CONTRAST = 1.2, 0.8, 0.3

_QUICK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_BODY = re.compile(r"<body\b", re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "textarea", "title", "noscript", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "head")}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INNER = frozenset(("br", "td", "th", "img", "wbr"))
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr"}, "tfoot": {"tbody", "thead", "tr"}}
_ENDS_P = _BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption", "option", "optgroup", "legend", "summary", "li", "dt", "dd"}
_GOOD_TAGS = frozenset(("article", "main"))
_BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation "
    "menu menus submenu sidebar sidebars sidenav rail aside footer foot masthead topbar toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices "
    "alert disclaimer copyright newsletter subscribe subscription signup signin login register popup modal overlay widget widgets share sharing social related recommended "
    "recommendations search searchbox skip skiplink legal paywall outbrain taboola complementary contentinfo navigation hidden".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond commentform discussion".split())
_HEADER_WORDS = frozenset(("header", "siteheader", "pageheader"))
_GOOD_ROLES = frozenset("article articlebody main maincontent".split())

#: First and last words of class names that say what an element has, is filed under or allows, not what it is.
_ABOUT_FIRST = frozenset("has with without no not is js category cat tag tagged term topic author format status type single page template lang in".split())
_ABOUT_LAST = frozenset("open opened closed enabled disabled on off yes no visible count true false".split())

#: Weights to begin with, and the centre of the prior: bias, link share, log of the length, sentence marks, heading, paragraph, list item, short; last, of the markup's hint.
START = np.array([-0.6, -4.0, 0.45, 1.0, 0.3, 0.8, -0.5, -0.4, 3.0])


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    tag: str
    parent: int  # number of the element around its own
    apart: int  # steps in the tree from the block before
    hint: float  # of the markup around it: above 0 content
    hidden: bool  # not shown
    comments: bool  # of readers


@dataclass(slots=True)
class _Frame:
    tag: str
    number: int
    hint: float
    hidden: bool
    comments: bool  # inside comments no hint at content counts


@lru_cache(1 << 14)
def role_words(value: str) -> frozenset[str]:
    """Words of the names in a class or id that say what the element is."""
    out: set[str] = set()
    for name in value.split():
        parts = _TOKEN.findall(_CAMEL.sub(" ", name).lower())
        if len(parts) > 1 and (parts[0] in _ABOUT_FIRST or parts[-1] in _ABOUT_LAST):
            continue
        out.update(parts)
        out.update(w.lower() for w in re.split(r"[^A-Za-z]+", name))
    return frozenset(out)


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Frame] = field(default_factory=lambda: [_Frame("", 0, 0.0, False, False)])
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    in_link: int = 0
    numbers: int = 0
    open_tags: Counter = field(default_factory=Counter)
    low: int = 1  # depth of the stack at its lowest since the last block
    before: int = 1  # and at that block

    def flush(self) -> None:
        if not self.parts:
            return
        text = _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
        if text:
            top, depth = self.stack[-1], len(self.stack)
            linked = len(_SPACE.sub(" ", entities.unescape("".join(self.links))).strip())
            parent = self.stack[-2].number if depth > 1 else 0
            self.blocks.append(Block(text, min(linked, len(text)), top.tag, parent, self.before + depth - 2 * self.low, top.hint, top.hidden, top.comments))
            self.low = self.before = depth
        self.parts.clear()
        self.links.clear()

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.in_link:
            self.links.append(text)

    def open(self, tag: str, attrs: str) -> None:
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if self.stack[-1].tag in closes:
            self.pop(len(self.stack) - 1)
        above = self.stack[-1]
        hidden, comments = above.hidden, above.comments
        words: set[str] = set()
        if attrs and "=" in attrs or "hidden" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    hidden = True
                elif name in ("class", "id", "role", "itemprop"):
                    words |= role_words(value)
        says = 0
        if tag not in ("body", "html"):
            if words & _COMMENT_WORDS:
                says, comments = -1, True
            else:
                bad = bool(tag in _BAD_TAGS or words & _BAD_WORDS or (tag == "header" or words & _HEADER_WORDS) and above.hint <= 0)
                says = bool(tag in _GOOD_TAGS or words & _GOOD_ROLES) - bad
            if comments:
                says = min(says, 0)
        hint = above.hint
        if says:
            hint = says * min(HINTS, 1.0 + KEPT * max(0.0, says * hint))
        self.numbers += 1
        self.open_tags[tag] += 1
        self.stack.append(_Frame(tag, self.numbers, hint, hidden, comments))

    def close(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k].tag != tag:
            k -= 1
        self.pop(k)

    def pop(self, depth: int) -> None:
        """Leave ``depth`` frames."""
        for frame in self.stack[depth:]:
            self.open_tags[frame.tag] -= 1
        del self.stack[depth:]
        self.low = min(self.low, depth)


@dataclass
class _Tags:
    """Tags of a page one by one. What was looked for in vain once isn't looked for again, so that all of it is linear."""

    source: str
    quotes: bool = True  # false once quotes were found to run to the end

    def end(self, at: int) -> int:
        """Behind the first ``>`` outside quotes, or of all; -1 if there is none."""
        start = at
        while self.quotes and (m := _STOP.search(self.source, at)) is not None:
            if m[0] == ">":
                return m.end()
            at = self.source.find(m[0], m.end()) + 1
            if not at:
                break
        self.quotes = False
        return self.source.find(">", start) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name in lower case, closes, attributes) of the first tag, comment or declaration; the name of the latter is empty."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if m := _QUICK.match(source, at):
                return at, m.end(), m[2].lower(), bool(m[1]), m[3]
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                return at, stop + 3 if stop >= 0 else len(source), "", False, ""
            if m := _NAME.match(source, at):
                stop = self.end(m.end())
                return (at, stop, m[2].lower(), bool(m[1]), source[m.end() : stop - 1]) if stop >= 0 else None
            if source.startswith(("<!", "<?"), at):
                stop = source.find(">", at)
                return (at, stop + 1, "", False, "") if stop >= 0 else None
            at += 1
        return None


def read_blocks(source: str) -> list[Block]:
    r, tags, at, n, headed = _Reader(), _Tags(source), 0, len(source), False
    while at < n:
        found = tags.next(at)
        if found is None:
            r.say(source[at:])
            break
        start, end, tag, closes, attrs = found
        if start > at:
            r.say(source[at:start])
        at = end
        if not tag:
            continue
        if not closes and tag in _RAW and not attrs.endswith("/"):
            if tag == "head":  # it may be left open
                if not headed:
                    stop, body = _RAW[tag].search(source, at), _BODY.search(source, at)
                    at = min(stop.end() if stop else n, body.start() if body else n) if stop or body else at
                headed = True
            else:
                stop = _RAW[tag].search(source, at)
                at = stop.end() if stop else n
            if tag in ("select", "button", "textarea"):
                r.say(" ")
            continue
        if tag == "a":
            r.in_link = 0 if closes else 1
        elif tag in _INNER:
            r.say(" ")
        elif tag in _BLOCK:
            r.flush()
            if closes:
                r.close(tag)
            elif tag not in _VOID:
                r.open(tag, attrs)
    r.flush()
    return r.blocks


def marked(b: Block) -> int:
    """1 where the markup hints at content, -1 at boilerplate, 0 where it doesn't say."""
    return -1 if b.hidden else (b.hint > 0) - (b.hint < 0)


def features(blocks: list[Block]) -> np.ndarray:
    out = np.empty((len(blocks), len(START)))
    for i, b in enumerate(blocks):
        size = len(b.text)
        out[i] = (
            1.0, b.linked / size, np.log1p(size) - 3.0, float(b.text[-1] in ".!?…。\"'”»"), float(b.tag[:1] == "h" and b.tag[1:].isdigit()),
            float(b.tag in ("p", "blockquote", "pre")), float(b.tag in ("li", "option", "dd")), float(size < 25), b.hint,
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, spread: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, with weights drawn to ``start``. ``y`` is 0, 1 or a probability; both labels weigh the same."""
    w = start.copy()
    if not len(y):
        return w
    share = (y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)) / 2 * min(len(y), 200)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + (w - start) / spread
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def looks(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(x[:, :-1] @ weights[:-1], -LOOKS, LOOKS)


def cotrain(x: np.ndarray, y: np.ndarray, comments: np.ndarray) -> np.ndarray:
    """Weights of the looks by labels of the markup, then of the hint by what the looks say."""
    w = np.append(fit(x[:, :-1], y, START[:-1]), START[-1])
    rest = ~comments
    said = 1 / (1 + np.exp(-looks(x[rest], w)))
    w[-1] = np.clip(fit(x[rest, -1:], said, START[-1:])[0], START[-1] / 2, START[-1] * 2)
    return w


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    last_under: dict[int, int] = {}

    def join(i: int, j: int, weight: float) -> None:
        out.append((i, j, weight if (blocks[i].hint > 0) - (blocks[i].hint < 0) == (blocks[j].hint > 0) - (blocks[j].hint < 0) else CONTRAST * weight))

    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, ADJACENT / (1 + 0.5 * b.apart))
        if (j := last_under.get(b.parent)) is not None:
            join(j, i, SIBLING)
        last_under[b.parent] = i
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost, by maximum flow between the terminals; content is what the source still reaches.

    A block labelled against its ``gain`` (content above 0) pays it, an edge across labels pays its weight.
    """
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def join(u: int, v: int, there: float, back: float) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((there, back))

    for i, g in enumerate(gain):
        join(*((s, i, g) if g > 0 else (i, t, -g)), 0.0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        level = [-1] * (t + 1)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, u = [0] * (t + 1), [], s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                cut = None
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cut is None and cap[e] <= 1e-9:
                        cut = k
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(e)
                u = to[e]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def gains(blocks: list[Block], weights: np.ndarray) -> list[float]:
    """What a block costs if it is labelled boilerplate, less what it costs as content."""
    x = features(blocks)
    z = np.clip(looks(x, weights) + x[:, -1] * weights[-1], -COST, COST)
    return [-HIDDEN if b.hidden else float(g) for b, g in zip(blocks, z)]


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    return min_cut(gains(blocks, weights), _edges(blocks)) if blocks else []


def turned(source: str, weights: np.ndarray) -> tuple[int, int, int]:
    """(blocks of a page, those that their edges could turn, those that the cut labels against their own gain)."""
    blocks = read_blocks(source)
    gain, edges = gains(blocks, weights), _edges(blocks)
    pull = [0.0] * len(gain)
    for i, j, w in edges:
        pull[i] += w
        pull[j] += w
    return len(blocks), sum(abs(g) < p for g, p in zip(gain, pull)), sum((g > 0) != x for g, x in zip(gain, min_cut(gain, edges)))


def extract(source: str | None, weights: np.ndarray = START) -> str:
    blocks = read_blocks(source or "")
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights)) if keep)


def train(pages: DataFrame, n_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from a bounded sample of pages (picked by a hash of id and html)."""
    total = pages.count()
    share = min(1.0, n_pages / total) if total else 1.0
    unit = F.pmod(F.xxhash64(F.lit("html"), "page_id", F.col("html").cast("string")), F.lit(1_000_003)) / 1_000_003

    def run(batches):
        for b in batches:
            for source in b.column("html").to_pylist():
                blocks = [x for x in read_blocks(source or "") if marked(x)]
                if blocks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(features(blocks).tolist(), pa.list_(pa.float64())), pa.array([marked(x) == 1 for x in blocks]), pa.array([x.comments for x in blocks])],
                        ["x", "y", "comments"],
                    )

    got = pages.where(unit < share).select(F.col("html").cast("string").alias("html")).mapInArrow(run, "x array<double>, y boolean, comments boolean")
    table = got.groupBy("x", "y", "comments").count().toArrow()  # of the bounded sample; equal blocks once with their count
    if not len(table):
        return START.copy()
    x, y, n = np.array(table["x"].to_pylist()), table["y"].to_numpy().astype(float), table["count"].to_numpy()
    return cotrain(np.repeat(x, n, axis=0), np.repeat(y, n), np.repeat(table["comments"].to_numpy().astype(bool), n))


def main_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    w = train(pages) if weights is None else weights

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x, w) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
