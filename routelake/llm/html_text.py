"""Main text of web pages: boosted trees over DOM nodes and hierarchical decoding.

Every block element of a page is a node with features of its subtree (text, link, tag and
punctuation density, words of class, id and role), of its place (depth, position, share of the
page, ancestors) and of its siblings. Gradient-boosted trees give the probability that the
node's text is article text. The decoder then labels the whole tree at once: a subtree is kept
as a whole, dropped as a whole, or split, at a cost, into its own text and its children; the
labelling with the highest likelihood wins, so a kept node never stands under a dropped one.

Training rows are made from a sample of at most ``SAMPLE_PAGES`` pages (the documented bound;
those with the smallest hash among the distinct pages that mark an article with text). Pages that
mark their article (``article``, ``main``) label their own nodes. Each is used as it is and in variants that carry the same article in other
containers, with further parts around and inside it (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), made from the sample's own words, whose labels are known.

Text: character references decoded, white space inside a block one space, blocks joined by one
space in page order. Inline elements, formulas among them, do not end a block; ``br`` does. Scripts,
styles and the other elements that HTML reads as raw text (``RAW``) are skipped; drawings, objects,
players, templates and ``noscript`` are nodes like others. The whole page is read and nothing else is
dropped.

Defined cases: null or empty html gives an empty text; a page without any article text gives
an empty text; broken markup is read as far as possible, open elements end with the page (an open script or
style takes the rest of it, as in HTML; other raw elements without an end tag are only a start tag);
without a page to learn from (none marks an article), all text outside of scripts and styles is kept; an empty table
gives an empty result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .util import python_ready, slices

SAMPLE_PAGES = 150
#: Variants of every sampled page.
VARIANTS = 4
#: Log-likelihood that splitting a node must gain.
SPLIT_COST = 1.0
SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of HTML by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
TO_THE_END = frozenset("script style".split())          # raw to the end of the page without an end tag
FOREIGN = frozenset("svg math".split())                 # in these, a start tag with a slash is a whole element
EMBEDDED = FOREIGN | frozenset("object canvas audio video template noscript".split())
ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ALIKE = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOT_IN_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "li", "ul ol menu dl", "div", "section", "article", "main", "nav", "header", "footer", "aside",
          "form button select option fieldset textarea input label legend dialog", "table tbody thead tr", "td th dt dd", "blockquote pre", "figure figcaption", "body html"]
# Words of class, id and role names, by what they often mark.
WORDS = ["nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager toc", "header masthead topbar banner logo branding", "footer copyright legal colophon",
         "sidebar aside rail widget complementary side", "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion commercial dfp",
         "cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe subscription signup paywall", "comment comments reply replies respond discussion disqus feedback commentlist",
         "share sharing social related recommended more popular trending links tags", "form search login register contact",
         "article content main post entry story body text prose page"]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_WORD = {w: i for i, g in enumerate(WORDS) for w in g.split()}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """tag, parent, words (bits of WORDS) and hidden of every block element; pieces: (node, text, in a link) and breaks (None) in page order."""

    def __init__(self):
        self.tag, self.parent, self.words, self.hidden = ["html"], [-1], [0], [False]
        self.pieces: list[tuple[int, str, bool] | None] = []

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        bits = 0
        if attributes:
            for found in NAMES.findall(attributes):
                for part in PARTS.findall("".join(found)):
                    at = _WORD.get(part.lower())
                    if at is not None:
                        bits |= 1 << at
        self.words.append(bits)
        self.hidden.append(bool(attributes) and ("hidden" in attributes or "display:none" in attributes.replace(" ", "")))
        return len(self.tag) - 1


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]      # open elements: name, block node that they belong to
    links = at = 0
    unclosed: set[str] = set()                        # raw elements that have no end tag from here on

    def text(piece: str):
        if piece and stack[-1][0] != "head":
            page.pieces.append((stack[-1][1], html.unescape(piece) if "&" in piece else piece, links > 0))

    def close(to: int):
        nonlocal links
        for name, _ in stack[to:]:
            links -= name == "a"
            if name not in INLINE:
                page.pieces.append(None)
        del stack[to:]

    while m := TOKEN.search(source, at):
        text(source[at:m.start()])
        at = m.end()
        if end := m[1]:
            end = end.lower()
            if end in ("html", "body"):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == end:
                    close(k)
                    break
                if end in INLINE and stack[k][0] not in INLINE:
                    break                               # an inline end tag does not close blocks
            continue
        if not (name := m[2]):
            continue
        name, attributes = name.lower(), m[3]
        if name in RAW:
            if not attributes.endswith("/"):
                done = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(source, at) if name not in unclosed else None
                if done:
                    at = done.end()
                elif name in TO_THE_END:
                    at = len(source)
                else:
                    unclosed.add(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                page.pieces.append(None)
            continue
        if attributes.endswith("/") and (name in EMBEDDED or any(n in FOREIGN for n, _ in stack)):
            continue
        if name == "html":
            continue
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            links += name == "a"
            continue
        if stack[-1][0] == "head" and name != "head":
            close(len(stack) - 1)
        if name in NOT_IN_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ALIKE.get(name, {name}):
                    close(k)
                    break
                if stack[k][0] in ENDS[name]:
                    break
        page.pieces.append(None)
        stack.append((name, page.add(name, stack[-1][1], attributes)))
    text(source[at:])
    return page


N_FEATURES = len(GROUPS) + 2 * len(WORDS) + len(GROUPS) + 17


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    own, words, link, marks = [0] * n, [0] * n, [0] * n, [0] * n
    begin: list = [None] * n
    total = 0
    for piece in page.pieces:
        if piece is None:
            continue
        node, text, linked = piece
        size = len(text.strip())
        if not size:
            continue
        if begin[node] is None:
            begin[node] = total
        total += size
        own[node] += size
        words[node] += text.count(" ") + 1
        marks[node] += text.count(",") + text.count(".")
        if linked:
            link[node] += size
    size, below, depth = own[:], [1] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    parent = page.parent
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        kids[parent[i]].append(i)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        words[p] += words[i]
        link[p] += link[i]
        marks[p] += marks[i]
        below[p] += below[i]
        if begin[i] is not None and (begin[p] is None or begin[i] < begin[p]):
            begin[p] = begin[i]
    out = np.zeros((n, N_FEATURES), np.float32)
    groups, marked = len(GROUPS), len(WORDS)
    above_words, above_tags = [0] * n, [0] * n
    rows = []
    for i in range(n):
        p = max(parent[i], 0)
        if i:
            above_words[i] = above_words[p] | page.words[p]
            g = _GROUP.get(page.tag[p], -1)
            above_tags[i] = above_tags[p] | (1 << g if g >= 0 else 0)
        g = _GROUP.get(page.tag[i], -1)
        if g >= 0:
            out[i, g] = 1
        for bits, shift, width in ((page.words[i], groups, marked), (above_words[i], groups + marked, marked), (above_tags[i], groups + 2 * marked, groups)):
            while bits:
                b = bits.bit_length() - 1
                out[i, shift + b] = 1
                bits ^= 1 << b
        around = kids[p]
        place = _index(kids, p, i)
        before = size[around[place - 1]] if i and place else 0
        after = size[around[place + 1]] if i and place + 1 < len(around) else 0
        s = size[i] or 1
        rows.append((math.log1p(size[i]), math.log1p(own[i]), link[i] / s, marks[i] / s, size[i] / max(words[i], 1), below[i] / s, below[i], depth[i],
                     place, len(around), size[i] / (total or 1), (begin[i] if begin[i] is not None else total) / (total or 1),
                     math.log1p(before), math.log1p(after), link[p] / (size[p] or 1), size[i] / (size[p] or 1), page.hidden[i]))
    out[:, -17:] = rows
    return out


def _index(kids, p, i):
    """Place of child i among its siblings; children are in ascending order."""
    from bisect import bisect_left
    return bisect_left(kids[p], i)


def decode(page: Page, p: np.ndarray, split_cost: float = SPLIT_COST) -> list[bool]:
    """Whether the own text of every node is kept: the likeliest labelling in which subtrees are kept, dropped or split."""
    n = len(page.tag)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    keep, drop = yes.tolist(), no.tolist()
    parts = np.maximum(yes, no).tolist()               # own text by itself, children by their best
    best, choice = [0.0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        split = parts[i] - split_cost
        best[i], choice[i] = max((keep[i], 1), (drop[i], 0), (split, 2))
        if i:
            up = page.parent[i]
            keep[up] += keep[i]
            drop[up] += drop[i]
            parts[up] += best[i]
    out = [False] * n
    for i in range(n):
        if i and choice[page.parent[i]] != 2:
            choice[i] = choice[page.parent[i]]
        out[i] = choice[i] == 1 or choice[i] == 2 and yes[i] > no[i]
    return out


def gather(page: Page, kept) -> str:
    """Kept text: blocks in page order, joined by one space."""
    blocks, block = [], []
    for piece in page.pieces:
        if piece is None:
            if block:
                blocks.append(" ".join("".join(block).split()))
                block = []
        elif kept is None or kept[piece[0]]:
            block.append(piece[1])
    if block:
        blocks.append(" ".join("".join(block).split()))
    return " ".join(b for b in blocks if b)


def labels(page: Page) -> list[bool] | None:
    """Article text by the page's own markup: inside ``article`` or ``main``, outside of parts that are marked as something else."""
    n = len(page.tag)
    if not any(t in ("article", "main") for t in page.tag):
        return None
    bad = {_GROUP[t] for t in ("nav", "header", "footer", "aside", "form")}
    out, cut = [False] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        marked = page.words[i] & ((1 << len(WORDS) - 1) - 1) and not page.words[i] >> len(WORDS) - 1
        cut[i] = i > 0 and cut[p] or _GROUP.get(page.tag[i]) in bad or bool(marked) or page.hidden[i]
        out[i] = not cut[i] and (page.tag[i] in ("article", "main") or i > 0 and out[p])
    return out


# Containers of the training variants, as start tags.
ARTICLES = ["<article>", "<main>", '<div class="article">', '<div class="post-content">', '<div id="content">', '<section class="story">', "<div>", '<div class="entry">', "<section>"]
MENUS = ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation" role="navigation">', '<ul class="breadcrumbs">', '<div class="related-links">', '<div class="share">', "<ul>"]
SIDES = ["<aside>", '<div class="sidebar">', '<div id="right-rail">', '<div class="widget">', '<section class="related">']
ADVERTS = ['<div class="ad">', '<div class="advert">', '<section class="sponsored">', '<div id="ads-top">', '<div class="promo">', '<aside class="ad">']
NOTICES = ['<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div class="newsletter">', '<div role="alert">', '<section class="popup">', '<div class="banner">', '<p class="notice">']
COMMENTS = ['<div id="comments">', '<section class="comments">', '<ol class="commentlist">', '<div class="reader-comments">', '<div class="discussion">']
ENDINGS = ["<footer>", '<div class="footer">', '<div id="copyright">', "<footer class=\"site-footer\">"]
STARTS = ["<header>", '<div class="header">', '<div id="masthead">', "<header class=\"site-header\">"]


def variant(page: Page, label: list[bool], said: list[str], rng: random.Random) -> tuple[str, str]:
    """A page with the same article in another container and other parts around it: (html, marker of the article's blocks).

    Blocks of the article are written with the attribute that the marker names, so their labels are known."""
    mark = "data-kept"
    blocks = []
    found = _blocks(page, label)
    if rng.random() < 0.4:                              # short articles are rare, and easily taken for other parts
        found = found[:rng.randint(1, 3)]
    for tag, text in found:
        if rng.random() < 0.15:
            text = " ".join(text.split()[:rng.randint(2, 12)])
        blocks.append(f"<{tag} {mark}>{html.escape(text, quote=False)}</{tag}>")

    def prose(most=60):
        words = rng.choice(said).split()
        k = rng.randrange(max(1, len(words) - 3))
        return html.escape(" ".join(words[k:k + rng.randint(2, most)]), quote=False)

    def wrap(start, inner):
        return f"{start}{inner}</{start[1:].split()[0].rstrip('>')}>"

    def menu():
        items = [f'<a href="#">{prose(3)}</a>' for _ in range(rng.randint(3, 9))]
        start = rng.choice(MENUS)
        return wrap(start, "".join(f"<li>{x}</li>" for x in items) if start.startswith("<ul") or rng.random() < 0.5 else " ".join(items))

    def form():
        return wrap(rng.choice(["<form>", '<form class="search">', '<div class="form">']), f"<label>{prose(4)}</label><input><button>{prose(2)}</button>")

    def paragraphs(start, most=2, size=40):
        if start.startswith("<p"):
            return wrap(start, prose(size))
        item = "li" if start.startswith("<ol") else "p"
        return wrap(start, "".join(f"<{item}>{prose(size)}</{item}>" for _ in range(rng.randint(1, most))) if rng.random() < 0.7 or item == "li" else prose(size))

    def part(kind):
        return {"menu": menu, "form": form, "side": lambda: wrap(rng.choice(SIDES), menu() if rng.random() < 0.5 else f"<h3>{prose(4)}</h3><p>{prose(25)}</p>"),
                "ad": lambda: paragraphs(rng.choice(ADVERTS), 1, 20), "notice": lambda: paragraphs(rng.choice(NOTICES), 2, 30),
                "comments": lambda: paragraphs(rng.choice(COMMENTS), 8, 70), "end": lambda: paragraphs(rng.choice(ENDINGS), 1, 15),
                "start": lambda: wrap(rng.choice(STARTS), f"<h2>{prose(4)}</h2>" + (menu() if rng.random() < 0.5 else f"<p>{prose(8)}</p>"))}[kind]()

    inside = [k for k in ("ad", "notice", "menu", "form", "side", "comments") if rng.random() < 0.2]
    for kind in inside:
        blocks.insert(rng.randint(1, len(blocks)) if kind != "comments" else len(blocks), part(kind))
    article = wrap(rng.choice(ARTICLES), "".join(blocks))
    if rng.random() < 0.4:
        article = wrap(rng.choice(['<div class="wrapper">', "<div>", "<main>", '<div class="container">']), article)
    before = [part(k) for k in ("start", "menu", "notice", "ad", "form") if rng.random() < 0.6]
    after = [part(k) for k in ("side", "comments", "ad", "menu", "form", "notice", "end") if rng.random() < 0.55]
    rng.shuffle(before)
    return f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>", mark


def _blocks(page: Page, label: list[bool]) -> list[tuple[str, str]]:
    out, block, tag = [], [], "p"
    for piece in [*page.pieces, None]:
        if piece is None:
            text = " ".join("".join(block).split())
            if text:
                out.append((tag if tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre") else "p", text))
            block = []
        elif label[piece[0]]:
            block.append(piece[1])
            tag = page.tag[piece[0]]
    return out


def _shares(page: Page, kept: list[bool]) -> tuple[list[int], list[int]]:
    """Characters of every subtree, and those of them that are article text."""
    n = len(page.tag)
    size, good = [0] * n, [0] * n
    for piece in page.pieces:
        if piece:
            k = len(piece[1].strip())
            size[piece[0]] += k
            good[piece[0]] += k * kept[piece[0]]
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        good[page.parent[i]] += good[i]
    return size, good


def marked(source: str) -> tuple[Page, list[bool]] | None:
    """The page and its labels, if it marks an article that has text."""
    page = parse(source)
    y = labels(page)
    return (page, y) if y and _blocks(page, y) else None


def learn(sources: list[str], variants: int = VARIANTS) -> BoostedTrees | None:
    """Trees from the pages that mark their article."""
    rng = random.Random(11)
    pages = [found for s in sources if (found := marked(s))]
    if not pages:
        return None
    said = [text for p, y in pages for _, text in _blocks(p, y)]
    cases = []
    for page, y in pages:
        cases.append((page, y))
        for _ in range(variants):
            source, mark = variant(page, y, said, rng)
            known = [mark in (m[3] or "") for m in TOKEN.finditer(source) if m[2] and m[2].lower() not in INLINE | VOID | RAW | {"html"}]
            made = parse(source)
            cases.append((made, [False, *known]))
    x, y, weight = [], [], []
    for page, kept in cases:
        size, good = _shares(page, kept)
        x.append(features(page))
        y += [good[i] * 2 > size[i] if size[i] else kept[i] for i in range(len(size))]
        weight += [0.0 if not s else 1.0 if g in (0, s) else 0.3 for s, g in zip(size, good, strict=True)]
    return BoostedTrees(np.concatenate(x), np.array(y, float), np.array(weight))


def extract(source: str | None, model: BoostedTrees | None) -> str:
    return extract_all([source], model)[0]


def extract_all(sources: list[str | None], model: BoostedTrees | None) -> list[str]:
    """Texts of several pages; the trees see all their nodes at once."""
    pages = [parse(s) if s else Page() for s in sources]
    if model is None:
        return [gather(p, None) for p in pages]
    rows = [features(p) for p in pages]
    scores = model.probability(np.concatenate(rows)) if rows else []
    out, at = [], 0
    for page, r in zip(pages, rows, strict=True):
        out.append(gather(page, decode(page, scores[at:at + len(r)])))
        at += len(r)
    return out


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, html_col: str = "html") -> BoostedTrees | None:
    """Learns from the marked pages with the smallest hashes of their html; copies of a page count once."""
    python_ready(pages.sparkSession)
    rows = pages.select(F.xxhash64(F.col(html_col)).alias("key"), F.col(html_col).cast("string").alias("html")).filter(F.col("html").rlike("(?i)<(?:article|main)"))

    def smallest(batches):
        """Keys of a partition's sample; a page is parsed only if its key could be among them."""
        import pyarrow as pa
        heap, seen = [], set()                          # heap: negative keys, the largest key first
        for part in slices(batches, 128):
            for key, source in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if key in seen or len(heap) == sample_pages and key > -heap[0] or not marked(source.as_py()):
                    continue
                seen.add(key)
                if len(heap) < sample_pages:
                    heapq.heappush(heap, -key)
                else:
                    seen.discard(-heapq.heappushpop(heap, -key))
        yield pa.RecordBatch.from_arrays([pa.array([-k for k in heap], pa.int64())], names=["key"])

    keys = rows.mapInArrow(smallest, "key long").distinct().orderBy("key").limit(sample_pages)
    sample = rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("html").alias("html")).orderBy("key").collect()
    return learn([r.html for r in sample])


def extract_pages(pages: DataFrame, model: BoostedTrees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        for part in slices(batches, 128):
            texts = extract_all(part.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)
