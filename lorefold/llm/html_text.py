"""HTML extraction: gradient-boosted trees over the nodes of a page, decoded from the root down.

A page is read into a tree of block nodes (markup outside a known element, unclosed paragraphs and stray end tags
are tolerated). Each node has features of its subtree (text, link and tag density, sentence marks), its tag and
attribute tokens and those above it, its depth and its siblings. Boosted trees, fitted here, give each node the
log-odds of belonging to the main text. Decoding keeps the set of nodes with the greatest total log-odds, weighted
by text, in which no node is kept under a dropped one; the kept nodes' own texts are the page's text.

Fitting: a bounded sample of pages (TRAIN_PAGES, by a hash of the id) goes to the driver. Nodes inside an article
or main element are main text, others are not. As real pages name these parts in many ways, each sampled page is also
used with its elements renamed and with notices, forms, sidebars, headers and reader comments set in, made of other
pages' sentences.

Edge cases: null, empty and text-free pages give an empty text; a page is read whole however long; repeated rows
give repeated results; a head without its end takes nothing with it, nor do skipped elements without one (but scripts and styles); a page's own attributes never label it; where no page has an article or main element the trees learn from
what the names of elements suggest; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 240
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.25
HASHED = 24  # columns of hashed attribute words
#: Elements whose contents are no text of the page. The first two hold to the page's end if they are not closed.
RAW, SKIPPED = ("script", "style"), ("noscript", "template", "svg", "iframe", "textarea", "title")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW + SKIPPED) + r")(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>",
    re.S | re.I,
)
_CLOSED = {k: re.compile(rf"</{k}\s*>", re.I) for k in RAW + SKIPPED}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-part)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
#: Element kinds of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"html", "body", "td", "th"}
GROUPS = {
    "main": "article main content contents post entry story body text".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager".split(),
    "edge": "header footer head foot masthead topbar bottom copyright colophon site".split(),
    "side": "aside sidebar side rail complementary widget widgets related recommended more".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter paywall".split(),
    "talk": "comment comments commentlist discussion replies reply disqus respond reader readers".split(),
    "form": "form fieldset login signup search label button input select".split(),
    "share": "share sharing social tags meta byline author date".split(),
}
_GROUP_OF = {w: k for k, ws in enumerate(GROUPS.values()) for w in ws}


@dataclass
class Page:
    """Nodes in document order: parent, tag, own text parts, and the counts that features need."""

    parent: list[int]
    tag: list[str]
    names: list[int]  # bit set of GROUPS
    hashed: list[int]  # bit set of hashed attribute words
    gold: list[int]
    text: list[list[str]]
    order: list[tuple[int, str]]  # (node, raw text) in page order; a new item when blocks change
    links: list[int]
    tags: list[int]


def parse(source: str, mark: str | None = None) -> Page:
    """The page's nodes; with mark, elements whose data-part is mark-1 or mark-0 are labelled, and all that lies in them."""
    page = Page([-1], [""], [0], [0], [-1], [[]], [], [0], [0])
    stack, link, at, never = [0], 0, 0, set()  # never: skipped elements of which no end follows

    def text(part: str) -> None:
        if part:
            node = stack[-1]
            page.order.append((node, part))
            if link:
                page.links[node] += len(part)

    while m := _TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                kind = m[1].lower()
                end = None if kind in never or m[0].endswith("/>") else _CLOSED[kind].search(source, at)
                if end:
                    at = end.end()
                elif kind in RAW:
                    at = len(source)
                elif not m[0].endswith("/>"):
                    never.add(kind)  # nothing is lost behind it
                text(" ")
            continue
        name = name.lower()
        node = stack[-1]
        page.tags[node] += 1
        if name not in BLOCKS:
            if name == "a":
                link = 0 if m[2] else 1
            elif name in ("br", "img", "input", "option", "button", "label"):
                text(" ")
            if name not in ("label", "button", "select"):
                continue
            page.names[node] |= 1 << _GROUP_OF[name]
            continue
        link = 0
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if page.tag[stack[k]] == name:
                    del stack[k:]
                    break
            else:
                if name == "p":
                    page.order.append((stack[-1], "\n"))
            page.order.append((stack[-1], ""))
            continue
        if name in ENDS_P and page.tag[stack[-1]] == "p":
            stack.pop()
        if name in ("li", "dd", "dt", "tr", "td", "th", "option") and page.tag[stack[-1]] == name:
            stack.pop()
        node = stack[-1]
        names, hashed, gold = 0, 0, page.gold[node]
        if name in _GROUP_OF:
            names |= 1 << _GROUP_OF[name]
        for a in _ATTRIBUTE.finditer(m[4] or ""):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "data-part":
                if mark and value in (f"{mark}-0", f"{mark}-1"):
                    gold = int(value[-1])
                continue
            for w in _NAMES.findall(value):
                w = w.lower()
                hashed |= 1 << zlib.crc32(w.encode()) % HASHED
                if (g := _GROUP_OF.get(w)) is not None:
                    names |= 1 << g
        page.parent.append(node)
        page.tag.append(name)
        page.names.append(names)
        page.hashed.append(hashed)
        page.gold.append(gold)
        page.links.append(0)
        page.tags.append(0)
        page.order.append((len(page.tag) - 1, ""))
        if name != "hr":
            stack.append(len(page.tag) - 1)
    text(source[at:])
    return page


def blocks_of(page: Page) -> list[tuple[int, str]]:
    """(node, text) of the page's blocks in page order, decoded, with single spaces."""
    out: list[tuple[int, str]] = []
    node, parts = -1, []
    for n, part in [*page.order, (-2, "")]:
        if n != node or part in ("", "\n"):
            joined = " ".join(html.unescape("".join(parts)).split())
            if joined:
                out.append((node, joined))
            node, parts = n, []
        if part != "\n":
            parts.append(part)
    return out


_MARKS = re.compile(r"[.!?;:,。！？]")
N_GROUPS = len(GROUPS)
_KINDS = {**dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), "p": 2, "li": 3, "div": 4}


def features(page: Page, blocks: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x features, own text length of each node)."""
    n = len(page.tag)
    own, marks, pieces = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text in blocks:
        own[node] += len(text)
        marks[node] += len(_MARKS.findall(text))
        pieces[node] += 1
    whole, links, tags, mark, items = own.copy(), np.array(page.links, float), np.array(page.tags, float), marks.copy(), pieces.copy()
    kids, same = np.zeros(n), np.zeros(n)
    parent = page.parent
    depth, above = np.zeros(n), np.zeros(n, np.int64)
    place, count_of = np.zeros(n), {}
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        above[k] = above[p] | page.names[p]
        place[k] = kids[p]
        kids[p] += 1
        key = (p, page.tag[k])
        count_of[key] = count_of.get(key, 0) + 1
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for x in (whole, links, tags, mark, items):
            x[p] += x[k]
    sibling = np.zeros(n)
    for k in range(1, n):
        same[k] = count_of[(parent[k], page.tag[k])]
        sibling[k] = whole[parent[k]] - whole[k]
    names, hashed = np.array(page.names), np.array(page.hashed)
    kind = np.array([_KINDS.get(t, 0) for t in page.tag])
    bits = 1 << np.arange(N_GROUPS)
    up = np.array(parent)
    up[0] = 0
    columns = [
        np.log1p(own), np.log1p(whole), links / np.maximum(whole, 1), tags / np.maximum(whole, 1), mark / np.maximum(whole, 1),
        whole / np.maximum(items, 1), whole / max(whole[0], 1), depth, place / np.maximum(kids[up], 1), kids[up], same / np.maximum(kids[up], 1),
        np.log1p(sibling), kids, kind == 1, kind == 2, kind == 3, kind == 4,
        *((names & b) > 0 for b in bits), *((above & b) > 0 for b in bits), *((hashed & b) > 0 for b in 1 << np.arange(HASHED)),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1), own


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes of a full tree of DEPTH levels
    limit: np.ndarray
    value: np.ndarray  # trees x leaves, log-odds

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > limit[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
    """Gradient boosting of full trees on binned features with second-order steps."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    share = np.average(y, weights=w) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, limit, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low, width = 2**level - 1, 2**level
            gain, split = np.full(width, 1e-6), [(0, np.inf, BINS)] * width
            for f in range(x.shape[1]):
                key = (node - low) * BINS + binned[:, f]
                g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(1)
                G, H = g[:, -1:], h[:, -1:]
                s = g**2 / (h + 1) + (G - g) ** 2 / (H - h + 1) - G**2 / (H + 1)
                s = s[:, : len(cuts[f])]
                if s.shape[1]:
                    best = s.argmax(1)
                    for k in np.flatnonzero(s[np.arange(width), best] > gain):
                        gain[k], split[k] = s[k, best[k]], (f, float(cuts[f][best[k]]), int(best[k]))
            right = np.zeros(len(y), np.int64)
            for k, (f, at, bin_) in enumerate(split):
                feature[t, low + k], limit[t, low + k] = f, at
                mine = node == low + k
                right[mine] = binned[mine, f] > bin_
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = RATE * g / (h + 1)
        total += value[t][leaf]
    return Trees(base, feature, limit, value)


def kept_nodes(page: Page, odds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nodes of the best selection in which every kept node's ancestors are kept."""
    gain = odds * own
    for k in range(len(gain) - 1, 0, -1):
        if gain[k] > 0:
            gain[page.parent[k]] += gain[k]
    keep = np.zeros(len(gain), bool)
    keep[0] = True
    for k in range(1, len(gain)):
        keep[k] = keep[page.parent[k]] and gain[k] > 0
    return keep


#: The parts of a page and how they may be written: fixed values.
MAIN_AS = ("article", "main", "div class=content", "div id=main-content", "section class=post-body", "div class=entry", "div class=story", "div role=main", "div")
MENU_AS = ("nav", "div class=menu", "ul class=navbar", "div id=navigation", "div class=breadcrumbs", "header", "div class=tabs")
FOOT_AS = ("footer", "div class=footer", "div id=bottom", "div class=site-footer", "div class=copyright")
SIDE_AS = ("div class=ad", "aside", "div class=sidebar", "div class=promo", "div class=cookie-notice", "div class=banner", "div class=related-posts", "div id=newsletter", "div class=sponsored", "div class=alert", "div class=widget", "header", "div class=site-header")
TALK_AS = ("section class=comments", "div id=comments", "div class=comment-list", "ul class=replies", "div class=reader-comments")


def altered(source: str, talk: list[str], r: random.Random, mark: str) -> str:
    """The page with its parts renamed and other parts set in, each marked with what it is."""

    def wrap(as_: str, gold: int, inner: str) -> str:
        name = as_.split()[0]
        return f'<{as_} data-part="{mark}-{gold}">{inner}</{name}>'

    def rename(page: str, tag: str, as_: str, gold: int) -> str:
        page = re.sub(rf"<{tag}\b([^>]*)>", lambda m: f'<{as_} data-part="{mark}-{gold}">', page, flags=re.I)
        return re.sub(rf"</{tag}\s*>", f"</{as_.split()[0]}>", page, flags=re.I)

    def words(most: int) -> str:
        return " ".join(r.sample(talk, min(len(talk), r.randint(1, most)))) if talk else "x"

    side = r.choice(SIDE_AS)
    page = re.sub(r'<div class="ad">', lambda m: f'<{side} data-part="{mark}-0">', source)
    page = page if side.startswith("div") else re.sub(rf'(<{side.split()[0]} data-part="{mark}-0">[^<]*)</div>', rf"\1</{side.split()[0]}>", page)
    tag = "article" if re.search(r"<article\b", source, re.I) else "main"
    inside = ""
    if r.random() < 0.5:
        comments = "".join(r.choice(("<p>{}</p>", "<div>{}</div>", "<li>{}</li>")).format(words(6)) for _ in range(r.randint(1, 5)))
        inside = wrap(r.choice(TALK_AS), 0, "<h3>" + words(1) + "</h3>" + comments)
    if r.random() < 0.3:
        inside += wrap("form", 0, f"<label>{words(1)}</label><input><p>{words(2)}</p><button>{words(1)}</button>")
    early = wrap(r.choice(SIDE_AS), 0, f"<p>{words(4)}</p>") if r.random() < 0.4 else ""
    within = r.random() < 0.5
    page = re.sub(rf"</{tag}\s*>", lambda m: (inside + m[0]) if within else (m[0] + inside), page, flags=re.I)
    page = re.sub(r"(<body[^>]*>)", lambda m: m[1] + early, page, flags=re.I)
    if r.random() < 0.4:
        extra = wrap(r.choice(SIDE_AS), 0, "".join(f"<p>{words(5)}</p>" for _ in range(r.randint(1, 3))))
        page = re.sub(rf"</{tag}\s*>", lambda m: (extra + m[0]) if r.random() < 0.4 else (m[0] + extra), page, flags=re.I)
    page = rename(page, tag, r.choice(MAIN_AS), 1)
    page = rename(page, "nav", r.choice(MENU_AS), 0)
    return rename(page, "footer", r.choice(FOOT_AS), 0)


LABELLED = "(?i)<(article|main)\\b"


def fit(pages: list[str], seed: int = 5) -> Trees | None:
    """Boosted trees from pages with an article or main element; if none has one, from what the names of elements suggest."""
    pages = [p for p in pages if p]
    named = [p for p in pages if re.search(LABELLED, p)]
    r = random.Random(seed)
    mark = f"{r.getrandbits(96):x}"
    xs, ys, ws = [], [], []

    def add(page: Page, label) -> None:
        x, own = features(page, blocks_of(page))
        use = own > 0
        xs.append(x[use])
        ys.append(label(page, x)[use])
        ws.append(1 + np.log1p(own[use]))

    if named:
        talk = [s for p in named for _, b in blocks_of(parse(p)) for s in re.split(r"(?<=[.!?])\s+", b) if len(s) > 15][:5000]
        for source in named:
            plain = re.sub(r"<(article|main)\b", rf'<\1 data-part="{mark}-1"', source, flags=re.I)
            for version in (plain, *(altered(source, talk, r, mark) for _ in range(3))):
                add(parse(version, mark), lambda page, x: np.array(page.gold) == 1)
    else:
        for source in pages:
            add(parse(source), lambda page, x: by_names(x) > 0)
    if not sum(len(y) for y in ys):
        return None
    x, y, w = np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)
    return boost(x, y, w / w.mean())


def by_names(x: np.ndarray) -> np.ndarray:
    """What the names of elements suggest, as log-odds: labels to learn from where no page has a main part of its own."""
    names = x[:, 17 : 17 + N_GROUPS] + x[:, 17 + N_GROUPS : 17 + 2 * N_GROUPS]
    return 1.0 + 2 * names[:, 0] - 6 * names[:, 1:8].max(1) - 4 * (x[:, 2] > 0.5)


def extracted(sources: list[str | None], trees: Trees | None) -> Iterator[str]:
    read = []
    for source in sources:
        page = parse(source or "")
        blocks = blocks_of(page)
        read.append((page, blocks, *features(page, blocks)))
    if not read:
        return
    every = np.concatenate([x for _, _, x, _ in read])
    odds = trees.score(every) if trees else np.zeros(len(every))
    at = 0
    for page, blocks, x, own in read:
        keep = kept_nodes(page, odds[at : at + len(x)], own)
        own_odds = odds[at : at + len(x)]
        at += len(x)
        yield "\n".join(t for node, t in blocks if keep[node] and own_odds[node] > 0)


def sampled(pages: DataFrame, page_id: str, html_col: str) -> list[str]:
    """About TRAIN_PAGES pages by a hash of id and page, four times as many at most."""
    total = pages.count()
    below = int(min(1.0, TRAIN_PAGES / max(total, 1)) * (1 << 30))
    rows = pages.where(F.pmod(F.xxhash64(page_id, html_col, F.lit(3)), F.lit(1 << 30)) < below)
    return [r[0] for r in rows.select(html_col).limit(4 * TRAIN_PAGES).collect()]


def extract(
    pages: DataFrame, html_col: str = "html", page_id: str = "page_id", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """The keep columns with text and n_chars (long) of every row."""
    trees = fit(sampled(pages.where(F.col(html_col).rlike(LABELLED)), page_id, html_col) or sampled(pages, page_id, html_col))
    sent = pages.sparkSession.sparkContext.broadcast(trees)
    schema = pages.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out = list(extracted(part.column(html_col).to_pylist(), sent.value))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    schema.names,
                )

    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
