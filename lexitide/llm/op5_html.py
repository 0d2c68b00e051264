"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A small reader turns a page into a tree of block-level elements; inline elements are transparent, and script,
style and the like hold no text, nor do inline elements whose class or id names an advert. Every element has features: its tag, its tokens of class, id and role, hashed, depth, subtree
text density, link share, sibling statistics, place on the page, and whether a tag or token on the way down to it is a cue. The trees give
each element the log-odds of being main content. Decoding keeps or drops whole subtrees: an element can
only be kept if all its ancestors are, and the choice with the largest sum over the page wins, from the leaves up.

The trees are trained in numpy on the driver, on at most TRAIN_NODES elements, evenly spaced, of each of at most TRAIN_PAGES
pages (those with the smallest hashes), whose labels follow from the vocabulary of tags and
tokens (nav, footer, class="ad", article ...). Each row is used four more times: with these cues hidden, with the tokens
hidden too, so densities and siblings are learned, and under a good and a bad cue with the label that the cue gives, so a
cue of a kind that the sample lacks (a reader comment in an article) still counts. Elements without any cue are not
trained on. A page that has no cue at all is labelled by density instead: long text with punctuation and few links is content,
lists of links and scraps aren't. Where the sample has neither, there are no trees, and all text outside silent elements is kept.

Kept text: character references decoded, white space inside a block made one space, blocks trimmed and
joined by one line feed in page order, empty blocks left out. Null and empty html gives an empty text. A tag ends at the first >
outside a quoted value; one that never ends is text if no > follows, else it takes the rest of the page. A script or style without an end
takes the rest of the page, other elements of raw text are then read on as if their tag weren't there. A header inside content belongs to it, unless most of it is links. Every input row
gives one row; repeated and null page_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import sample
from lexitide.runtime import Scratch, bound_batches, table

TRAIN_PAGES, TRAIN_NODES, TREES, DEPTH, BINS, RATE = 1000, 256, 30, 3, 32, 0.3
TOKEN_PLACES = 32

# The vocabulary of markup.
SILENT = frozenset("script style noscript template svg math iframe object select option button textarea title head canvas audio video map".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl body html article section div main aside nav header footer form blockquote".split())
GOOD_TAGS, BAD_TAGS = ("article", "main"), ("nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset")
GOOD_WORDS = frozenset("article articlebody content entry story post main maincontent body text".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot "
    "sidebar aside side rail widget cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist reply replies respond discussion disqus "
    "share sharing social related recommended more subscribe subscription newsletter signup login search form pagination pager copyright legal tags toolbar skip".split()
)
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
CUE_NAMES = frozenset(("class", "id", "role", "itemprop"))
BLOCK_TAGS = ("p", "div", "li", "h1", "h2", "h3", "ul", "td", "section", "blockquote", "pre")
NAMES = (
    *(f"is_{t}" for t in BLOCK_TAGS), "good_path", "bad_path",
    "depth", "own_chars", "chars", "density", "links", "elements", "paragraphs", "siblings", "same_siblings", "order", "chars_of_siblings", "start", "stops", "word_length",
    *(f"token_{i}" for i in range(TOKEN_PLACES)),
)
TOKENS = NAMES.index("token_0")
CUES = tuple(i for i, n in enumerate(NAMES) if n.endswith("_path"))

# Every alternative that begins to match goes on to an end, so no character is tried again and again.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s>]*+)))?+")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?;:,]")


def cue_words(attributes: str) -> frozenset[str]:
    """Tokens of class, id, role and itemprop, and of no other attribute."""
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in CUE_NAMES:
            words.update(w.lower() for w in _SPLIT.findall(m[2] or m[3] or m[4] or ""))
    return frozenset(words)


class Page:
    """Block-level elements in page order, parents first; text pieces with their element."""

    def __init__(self, text: str):
        self.tag, self.words, self.parent = ["#"], [frozenset()], [-1]
        self.links = [0]  # characters inside links
        self.pieces: list[tuple[int, str]] = []
        self.opened, self.silent = Counter(), 0  # open elements by tag, and how many of them are silent
        self.hidden, self.depth, self.endless = None, 0, set()  # an inline advert's tag and how often it is open; raw tags that no end follows
        open_, link, at = [0], 0, 0
        end, last = len(text), text.rfind(">")
        while at < end:
            m = _MARKUP.search(text, at)
            if m and m.start() > last:  # no tag ends any more
                m = None
            stop = m.start() if m else end
            if stop > at and not self.silent and not self.hidden:
                self._say(open_[-1], entities.unescape(text[at:stop]), link)
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == self.hidden:
                    self.depth -= 1
                    self.hidden = self.hidden if self.depth else None
                if name == "a":
                    link = 0
                elif name not in INLINE:
                    self.hidden = None  # no inline element outlasts its block
                    self._close(open_, name)
                    self._say(open_[-1], None, 0)
                elif name in SILENT:
                    continue
                continue
            if name == "a":
                link = 1
            if name == "br":
                self._say(open_[-1], " ", 0)
            if name in INLINE or name in VOID:
                if name == "hr":
                    self._say(open_[-1], None, 0)
                elif name == self.hidden:
                    self.depth += 1
                elif not self.hidden and name not in VOID and m[3] and cue_words(m[3]) & AD_WORDS:
                    self.hidden, self.depth = name, 1
                continue
            if name in RAW:
                close = None if name in self.endless else re.compile(rf"</{name}\s*+>", re.I).search(text, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    at = end
                else:
                    self.endless.add(name)
                continue
            self._open(open_, name, m[3] or "")

    def _say(self, node: int, text: str | None, link: int) -> None:
        """Text of an element; None ends its block."""
        if text is None:
            if self.pieces and self.pieces[-1][1] is not None:
                self.pieces.append((node, None))
        else:
            self.pieces.append((node, text))
            self.links[node] += link * len(text.strip())

    def _cut(self, open_: list[int], i: int) -> None:
        for node in open_[i:]:
            self.opened[self.tag[node]] -= 1
            self.silent -= self.tag[node] in SILENT
        del open_[i:]

    def _close(self, open_: list[int], name: str) -> None:
        if self.opened[name] > 0:
            i = len(open_) - 1
            while self.tag[open_[i]] != name:
                i -= 1
            self._cut(open_, i)

    def _open(self, open_: list[int], name: str, attributes: str) -> None:
        if self.tag[open_[-1]] == "p":  # a block ends an open paragraph
            self._cut(open_, len(open_) - 1)
        if name in CLOSES and any(self.opened[t] for t in CLOSES[name]):
            for i in range(len(open_) - 1, 0, -1):
                if self.tag[open_[i]] in CLOSES[name]:
                    self._cut(open_, i)
                    break
                if self.tag[open_[i]] in SCOPES:
                    break
        self._say(open_[-1], None, 0)
        words = cue_words(attributes) if attributes else frozenset()
        if self.hidden:  # a block inside an inline advert
            words, self.hidden = words | {"advert"}, None
        self.tag.append(name)
        self.words.append(words)
        self.parent.append(open_[-1])
        self.links.append(0)
        open_.append(len(self.tag) - 1)
        self.opened[name] += 1
        self.silent += name in SILENT

    def blocks(self) -> list[tuple[int, str]]:
        """(element, text) of each run of text that no block-level tag interrupts."""
        out: list[tuple[int, list[str]]] = []
        fresh = True
        for node, text in self.pieces:
            if text is None:
                fresh = True
            elif fresh or out[-1][0] != node:
                out.append((node, [text]))
                fresh = False
            else:
                out[-1][1].append(text)
        return [(n, t) for n, ts in out if (t := _SPACE.sub(" ", "".join(ts)).strip())]


def features(page: Page, blocks: list[tuple[int, str]]) -> np.ndarray:
    n = len(page.tag)
    own, stops, runs, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, np.inf)
    place = 0
    for node, text in blocks:
        own[node] += len(text)
        stops[node] += len(_STOP.findall(text))
        runs[node] += text.count(" ") + 1
        first[node] = min(first[node], place)
        place += len(text)
    parent = np.array(page.parent)
    chars, links, elements, kids = own.copy(), np.array(page.links, dtype=float), np.ones(n), np.zeros(n)
    paragraphs = np.array([float(t == "p") for t in page.tag])
    all_stops, all_runs = stops.copy(), runs.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, links, elements, paragraphs, all_stops, all_runs):
            a[p] += a[i]
        first[p] = min(first[p], first[i])
        kids[p] += 1
    x = np.zeros((n, len(NAMES)))
    col = {name: k for k, name in enumerate(NAMES)}
    root = [t in ("#", "html", "body") for t in page.tag]
    good = np.array([not r and (t in GOOD_TAGS or bool(w & GOOD_WORDS)) for r, t, w in zip(root, page.tag, page.words)])
    bad = np.array([not r and (t in BAD_TAGS and t != "header" or bool((w - {"header"}) & BAD_WORDS)) for r, t, w in zip(root, page.tag, page.words)])
    header = np.array([not r and (t == "header" or "header" in w) for r, t, w in zip(root, page.tag, page.words)])
    depth, order, same = np.zeros(n), np.zeros(n), np.zeros(n)
    seen, tags = np.zeros(n), {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        order[i] = seen[p]
        seen[p] += 1
        tags[p, page.tag[i]] = tags.get((p, page.tag[i]), 0) + 1
        bad[i] |= bad[p]
        good[i] |= good[p]
        if header[i]:  # of the page, but for one inside content that isn't a menu
            bad[i] |= not good[i] or links[i] > 0.5 * chars[i]
        if (k := col.get("is_" + page.tag[i])) is not None:
            x[i, k] = 1
        for w in page.words[i]:
            x[i, TOKENS + crc32(w.encode()) % TOKEN_PLACES] = 1
    good &= ~bad  # a bad cue on the way down wins
    for i in range(1, n):
        same[i] = tags[parent[i], page.tag[i]]
    up = np.maximum(parent, 0)
    for name, v in (
        ("good_path", good), ("bad_path", bad), ("depth", depth), ("own_chars", np.log1p(own)), ("chars", np.log1p(chars)),
        ("density", chars / elements), ("links", np.minimum(links, chars) / np.maximum(chars, 1)), ("elements", np.log1p(elements)), ("paragraphs", np.log1p(paragraphs)), ("siblings", kids[up]),
        ("same_siblings", same), ("order", order / np.maximum(kids[up], 1)), ("chars_of_siblings", chars / np.maximum(chars[up], 1)),
        ("start", np.where(np.isfinite(first), first, place) / max(place, 1)), ("stops", all_stops / np.maximum(all_runs, 1)), ("word_length", chars / np.maximum(all_runs, 1)),
    ):
        x[:, col[name]] = v
    return x


def cue_labels(x: np.ndarray) -> np.ndarray:
    """1 content, 0 not, -1 no cue: what tags and tokens on the way down say; the bad ones win."""
    return np.where(x[:, NAMES.index("bad_path")] > 0, 0, np.where(x[:, NAMES.index("good_path")] > 0, 1, -1))


def density_labels(x: np.ndarray) -> np.ndarray:
    """The same for a page without cues: 1 for long text with punctuation and few links, 0 for links and scraps."""
    own, links, stops = (x[:, NAMES.index(k)] for k in ("own_chars", "links", "stops"))
    heading = x[:, [NAMES.index(f"is_h{i}") for i in (1, 2, 3)]].any(1)
    scrap = (links > 0.5) | ((own < np.log1p(25)) & (stops < 0.04))
    return np.where((own == 0) | heading, -1, np.where((own >= np.log1p(80)) & (links < 0.3) & (stops > 0.04), 1, np.where(scrap, 0, -1)))


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and cut of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.start + self.value[trees, at - (2**DEPTH - 1)].sum(1)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    share = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    # rows that fall into the same bins are one row with the weights of both labels
    narrow = np.ascontiguousarray(binned.astype(np.uint8))
    _, one, of = np.unique(narrow.view(np.dtype((np.void, narrow.shape[1]))).ravel(), return_index=True, return_inverse=True)
    x, binned = x[one], binned[one]
    ones, all_ = np.bincount(of, weight * y), np.bincount(of, weight)
    z, inner, leaves = np.full(len(x), start), 2**DEPTH - 1, 2**DEPTH
    features_, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = all_ * p - ones, all_ * np.maximum(p * (1 - p), 1e-6)
        at, feature, cut = np.zeros(len(x), dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            low, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                key = (at - low) * (BINS + 1) + binned[:, k]
                gs = np.bincount(key, g, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                hs = np.bincount(key, h, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, : len(e)]
                b = gain.argmax(1)
                better = gain[np.arange(count), b] > best
                best[better] = gain[np.arange(count), b][better]
                feature[low : low + count][better] = k
                cut[low : low + count][better] = e[b][better]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        z += value[leaf]
        features_.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(start, np.array(features_), np.array(cuts), np.array(values))


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Kept elements: the largest sum of scores of kept ones minus dropped ones, an element only below kept ones."""
    n = len(score)
    drop, keep = -score.copy(), score.copy()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return kept


def node_scores(page: Page, x: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Log-odds, weighted by how much an element says itself; containers of everything count nothing."""
    own = x[:, NAMES.index("own_chars")]
    score = np.clip(odds, -4, 4) * (1 + own)
    score[[t in ("#", "html", "body", "head") for t in page.tag]] = 0.0
    return score


def main_text(html: str | None, trees: Trees | None) -> str:
    if not html:
        return ""
    page = Page(html)
    blocks = page.blocks()
    if not blocks or trees is None:
        return "\n".join(t for _, t in blocks)
    x = features(page, blocks)
    odds = trees.log_odds(x)
    kept = decode(page, node_scores(page, x, odds))
    # text beside everything, in body itself, goes by its own score
    loose = odds > 0
    root = [t in ("#", "html", "body") for t in page.tag]
    return "\n".join(t for node, t in blocks if (loose[node] if root[node] else kept[node]))


def fit(pages: DataFrame, pages_bound: int = TRAIN_PAGES) -> Trees | None:
    bound_batches(pages.sparkSession)
    n = len(NAMES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels = [], []
            for html in b.column("html").to_pylist():
                page = Page(html)
                x = features(page, page.blocks())
                y = cue_labels(x)
                y = y if (y >= 0).any() else density_labels(x)
                at = np.nonzero(y >= 0)[0]
                at = at[np.linspace(0, len(at) - 1, min(len(at), TRAIN_NODES)).astype(int)] if len(at) else at
                rows.append(x[at].astype("<f4").tobytes())
                labels.append(y[at].astype("u1").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(rows, pa.binary()), pa.array(labels, pa.binary())], ["h", "x", "y"])

    own = pages.where(F.length("html") > 0).select(F.xxhash64("page_id", "html").alias("h"), "html")
    chosen = Scratch(pages.sparkSession, "html").save(sample(own.select("h").distinct(), pages_bound, "h"), "chosen")
    some = own.join(F.broadcast(chosen), "h").mapInArrow(look, "h long, x binary, y binary").groupBy("h").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    found = sorted(some.collect())
    found = [(np.frombuffer(r["x"], "<f4").reshape(-1, n).astype(float), np.frombuffer(r["y"], "u1")) for r in found]
    if not found or not sum(len(f[1]) for f in found):
        return None
    x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(float)
    share = max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / share[0], 0.5 / share[1])
    forms = [(x, y, weight)]
    for cues, tokens, labels in (((0, 0), True, y), ((0, 0), False, y), ((1, 0), False, np.ones(len(y))), ((0, 1), False, np.zeros(len(y)))):
        form = x.copy()
        form[:, CUES] = cues
        if not tokens:
            form[:, TOKENS:] = 0
        forms.append((form, labels, 0.3 * weight))
    x, y, weight = (np.concatenate([f[k] for f in forms]) for k in range(3))
    return boost(x, y, weight)


def extract(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    bound_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(h, trees) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
