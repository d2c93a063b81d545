"""Main text of web pages by a recurrent network that labels every block.

A page is read into its leaf blocks in page order. Each block is a vector: the
hashed steps of its tag path, its hashed words, and a few measures of its shape.
A bidirectional LSTM in numpy runs over the blocks of the page, so that the label of a
block depends on the whole page, and those labelled as article are joined.

The network is fitted anew for each table from a bounded sample: pages of the
table, labelled where landmarks of the markup leave no doubt, and page layouts drawn
at random around their words, whose labels are known. Blocks without landmarks
have no label in the former, and many of the latter have no telling names at all.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import hashed_words, text_blocks, with_columns

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                       "hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not part of the page's text.
SILENT = frozenset("script style title template iframe noscript svg canvas select textarea button object audio video datalist".split())
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: What an implied end doesn't reach beyond.
SCOPES = frozenset("ul ol dl table article section div main body form aside nav header footer".split())
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link: int = 0
    strong: int = 0


class Leaves(HTMLParser):
    """Blocks of a page: runs of text between the borders of block elements, with the steps that lead there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, list[str]]] = []
        self.parts: list[str] = []
        self.silent = self.links = self.strong = self.link = self.bold = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(tuple(s for _, steps in self.open for s in steps), text, self.link, self.bold))
        self.parts, self.link, self.bold = [], 0, 0

    def _pop(self, down_to: int):
        while len(self.open) > down_to:
            tag, _ = self.open.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.strong -= tag in ("b", "strong")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p" or self.open[k][0] in ENDS.get(tag, ()):
                    self._pop(k)
                    break
                if self.open[k][0] in SCOPES or (self.open[k][0] in BLOCK_TAGS and tag not in ENDS):
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        steps = []
        if tag in BLOCK_TAGS:
            steps = [tag]
            for name, value in attrs:
                if value and name in ("class", "id", "role", "itemprop", "aria-label"):
                    steps += [w.lower() for w in NAME_WORD.findall(value)]
                elif name == "hidden":
                    steps.append("hidden")
        self.open.append((tag, steps))
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.strong += tag in ("b", "strong")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCK_TAGS:
                    self.flush()
                self._pop(k)
                return
            if tag not in BLOCK_TAGS and self.open[k][0] in BLOCK_TAGS:
                return

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            n = len(data)
            self.link += n * (self.links > 0)
            self.bold += n * (self.strong > 0)


def leaves(html: str | None) -> list[Block]:
    """All blocks of a page that hold anything but white space, in page order."""
    p = Leaves()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.blocks


# ---- blocks as vectors -----------------------------------------------------------------

PATH_SLOTS, WORD_SLOTS = 1024, 1024
SHAPES = 10


def slot(step: str) -> int:
    return zlib.crc32(step.encode("utf-8", "replace")) % PATH_SLOTS


def features(pages: list[list[Block]]) -> tuple[tuple, tuple, np.ndarray]:
    """Over all blocks of all pages: (slot, block) of path steps, (slot, block) of words, and the measures of shape."""
    blocks = [b for page in pages for b in page]
    known: dict[tuple, list[int]] = {}
    steps, owner = [], []
    for i, b in enumerate(blocks):
        own = known.get(b.path)
        if own is None:
            own = known[b.path] = sorted({slot(s) for s in (*b.path, *(f"{x}/{y}" for x, y in zip(b.path[-3:], b.path[-2:])))})
        steps += own
        owner += [i] * len(own)
    words, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    texts = [b.text for b in blocks]
    for first, data, bounds in text_blocks(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())):
        h, row = hashed_words(data, bounds)
        both = np.unique((row + first) * WORD_SLOTS + (h % np.uint64(WORD_SLOTS)).astype(np.int64))  # each word of a block once
        words.append(both % WORD_SLOTS)
        rows.append(both // WORD_SLOTS)
    shape = np.zeros((len(blocks), SHAPES), np.float32)
    for i, b in enumerate(blocks):
        n = len(b.text)
        spaces = b.text.count(" ") + 1
        shape[i] = (np.log1p(n) / 6, np.log1p(spaces) / 4, min(1.0, b.link / n), min(1.0, b.strong / n), (b.text.count(".") + b.text.count(",")) / spaces, b.text[-1] in ".!?\"", 
                    n < 30, n > 200, min(1.0, len(b.path) / 8), 1.0)
    return (np.array(steps, np.int64), np.array(owner, np.int64)), (np.concatenate(words), np.concatenate(rows)), shape


# ---- the network -----------------------------------------------------------------------

WIDTH, HIDDEN = 32, 24


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {"path": r.normal(0, 0.1, (PATH_SLOTS, WIDTH)), "word": r.normal(0, 0.02, (WORD_SLOTS, WIDTH)), "shape": r.normal(0, 0.3, (SHAPES, WIDTH)),
         "out": r.normal(0, 0.1, (2 * HIDDEN + WIDTH, 1)), "bias": np.zeros((1, 1))}
    for side in ("f", "b"):
        w |= {f"x{side}": r.normal(0, 0.2, (WIDTH, 4 * HIDDEN)), f"h{side}": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"c{side}": np.zeros((1, 4 * HIDDEN))}
        w[f"c{side}"][0, HIDDEN:2 * HIDDEN] = 1  # remember at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def bag(table: np.ndarray, at: tuple[np.ndarray, np.ndarray], n: int, root: bool) -> np.ndarray:
    """Sum of the rows of `table` for each block, divided by the root of their number if asked for; a million entries at once."""
    slots, owner = at
    out = np.zeros((n, table.shape[1]), np.float32)
    for k in range(0, len(slots), 1 << 20):
        s, o = slots[k:k + (1 << 20)], owner[k:k + (1 << 20)]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        out[o[first]] += np.add.reduceat(table[s], first, axis=0)
    if root:
        out /= np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))[:, None].astype(np.float32)
    return out


def entered(w: dict, path: tuple, word: tuple, shape: np.ndarray) -> np.ndarray:
    return np.tanh(bag(w["path"], path, len(shape), False) + bag(w["word"], word, len(shape), True) + shape @ w["shape"])


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, mask), each [longest, pages]: which block each step of each page reads; steps beyond a page's end are masked."""
    first = np.cumsum(sizes) - sizes
    t = np.arange(sizes.max())[:, None]
    mask = t < sizes[None]
    return np.where(mask, first + t, 0), np.where(mask, first + sizes - 1 - t, 0), mask


def lstm(w: dict, side: str, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of each block after one run over the pages; `keep` gets what the way back needs."""
    steps, pages = at.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((len(x), HIDDEN), np.float32)
    into = x @ w[f"x{side}"] + w[f"c{side}"]
    for t in range(steps):
        g = into[at[t]] + h @ w[f"h{side}"]
        i, f, o = (sigmoid(g[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        z = np.tanh(g[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c2 = np.where(m, f * c + i * z, c)
        tc = np.tanh(c2)
        h2 = np.where(m, o * tc, h)
        if keep is not None:
            keep.append((i, f, o, z, c, tc, h, m))
        h, c = h2, c2
        live = mask[t]
        out[at[t][live]] = h[live]
    return out


def back(w: dict, side: str, x: np.ndarray, at: np.ndarray, keep: list, dout: np.ndarray, grads: dict) -> np.ndarray:
    """Gradients of one run, by going back through its steps; returns that of x."""
    dx_into = np.zeros((len(x), 4 * HIDDEN), np.float32)
    dh = np.zeros((at.shape[1], HIDDEN), np.float32)
    dc, gh = np.zeros_like(dh), np.zeros_like(w[f"h{side}"])
    for t in range(at.shape[0] - 1, -1, -1):
        i, f, o, z, c, tc, h, m = keep[t]
        d = np.where(m, dh + dout[at[t]], 0)
        dcc = np.where(m, dc + d * o * (1 - tc * tc), 0)
        g = np.concatenate([dcc * z * i * (1 - i), dcc * c * f * (1 - f), d * tc * o * (1 - o), dcc * i * (1 - z * z)], axis=1)
        live = m[:, 0]
        dx_into[at[t][live]] = g[live]
        gh += h.T @ g
        dh = np.where(m, g @ w[f"h{side}"].T, dh)
        dc = np.where(m, dcc * f, dc)
    grads[f"h{side}"], grads[f"x{side}"], grads[f"c{side}"] = gh, x.T @ dx_into, dx_into.sum(axis=0, keepdims=True)
    return dx_into @ w[f"x{side}"].T


def scores(w: dict, pages: list[list[Block]]) -> np.ndarray:
    """Log odds of being article, for all blocks of the pages one after another."""
    sizes = np.array([len(p) for p in pages], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.float32)
    out = np.zeros(sizes.sum(), np.float32)
    x = entered(w, *features(pages))
    first = np.cumsum(sizes) - sizes
    by = np.argsort(sizes, kind="stable")
    by = by[sizes[by] > 0]
    at = 0
    while at < len(by):  # pages of about equal length at once, 16,384 blocks or one page
        last = at + 1
        while last < len(by) and (last - at + 1) * sizes[by[last]] <= 1 << 14:
            last += 1
        group = by[at:last]
        rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in group])
        own = x[rows]
        forward, backward, mask = places(sizes[group])
        h = np.concatenate([lstm(w, "f", own, forward, mask), lstm(w, "b", own, backward, mask), own], axis=1)
        out[rows] = (h @ w["out"] + w["bias"])[:, 0]
        at = last
    return out


def learnt(pages: list[list[Block]], labels: list[list[float]], rounds: int = 6, seed: int = 0, batch: int = 24, rate: float = 0.006) -> dict[str, np.ndarray]:
    """Weights fitted to the labels (1 article, 0 not, NaN unknown) by Adam; every batch is gone back through completely."""
    w, r = fresh(seed), np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels) if p]) if any(pages) else ((), ())
    for _ in range(rounds):
        order = r.permutation(len(pages))
        for k in range(0, len(order), batch):
            own = [pages[i] for i in order[k:k + batch]]
            y = np.array([v for i in order[k:k + batch] for v in labels[i]], np.float32)
            known = ~np.isnan(y)
            if not known.any():
                continue
            path, word, shape = features(own)
            # Some blocks lose their paths, some their words: the rest of the page has to tell.
            path, word = (tuple(part[kept[at[1]]] for part in at) for at, kept in ((path, r.random(len(shape)) >= 0.15), (word, r.random(len(shape)) >= 0.3)))
            x = entered(w, path, word, shape)
            forward, backward, mask = places(np.array([len(p) for p in own], np.int64))
            kf, kb = [], []
            h = np.concatenate([lstm(w, "f", x, forward, mask, kf), lstm(w, "b", x, backward, mask, kb), x], axis=1)
            p = sigmoid((h @ w["out"] + w["bias"])[:, 0])
            d = (np.where(known, p - np.nan_to_num(y), 0) / known.sum()).astype(np.float32)[:, None]
            g = {"out": h.T @ d, "bias": d.sum(keepdims=True).reshape(1, 1)}
            dh = d @ w["out"].T
            dx = dh[:, 2 * HIDDEN:] + back(w, "f", x, forward, kf, dh[:, :HIDDEN], g) + back(w, "b", x, backward, kb, dh[:, HIDDEN:2 * HIDDEN], g)
            dx = dx * (1 - x * x)
            g["shape"] = shape.T @ dx
            g["path"], g["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            np.add.at(g["path"], path[0], dx[path[1]])
            scale = np.sqrt(np.maximum(1, np.bincount(word[1], minlength=len(shape))))[:, None].astype(np.float32)
            np.add.at(g["word"], word[0], (dx / scale)[word[1]])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for name, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-12))
                m1[name] = 0.9 * m1[name] + 0.1 * v
                m2[name] = 0.99 * m2[name] + 0.01 * v * v
                w[name] = (w[name] - rate * (m1[name] / (1 - 0.9 ** step)) / (np.sqrt(m2[name] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return w


# ---- what it learns from ----------------------------------------------------------------

#: Steps of a path that leave no doubt: inside an article; not part of one wherever they stand.
ARTICLE = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside form menu dialog ad ads advert advertisement sponsor sponsored promo banner cookie consent notice sidebar breadcrumb breadcrumbs "
                   "comment comments reply replies newsletter subscribe share social related widget popup modal pagination pager login toolbar hidden".split())


def landmarks(page: list[Block]) -> list[float]:
    """1 inside an article, 0 inside what belongs to none, NaN where the path has no such step."""
    out = []
    for b in page:
        steps = set(b.path)
        out.append(0.0 if steps & CHROME or ("header" in steps and not steps & ARTICLE) else 1.0 if steps & ARTICLE else float("nan"))
    return out


#: Phrases of page furniture, for layouts.
FURNITURE = ("Home", "About us", "Contact", "Privacy policy", "Terms of use", "Log in", "Sign up", "Subscribe to our newsletter", "We use cookies to improve this site.", "Accept all",
             "All rights reserved.", "Share this page", "Read more", "Related articles", "Most popular", "Next page", "Search", "Advertisement", "Sponsored", "Follow us", "Skip to content",
             "Leave a reply", "Your e-mail address", "Copyright", "Sitemap", "Back to top", "Buy now and save", "Free shipping on all orders")


def layouts(n: int, words: list[str], seed: int) -> tuple[list[list[Block]], list[list[float]]]:
    """Pages drawn at random: furniture around, between and inside an article, with telling names, with names that tell nothing, or without any."""
    r = np.random.default_rng(seed)
    words = words or ["word"]
    pick = lambda xs: xs[int(r.integers(len(xs)))]

    def say(lo, hi):
        n = int(np.exp(r.uniform(np.log(lo), np.log(hi + 1))))
        s = " ".join(words[int(k)] for k in r.integers(len(words), size=n))
        return escape(s[:1].upper() + s[1:] + pick((".", ".", "", "?")), quote=False)

    def page():
        named = pick(("tags", "tags", "names", "names", "none"))
        out, labels = [], []

        def put(text, label, tag="p", inner=None):
            out.append(f"<{tag}>{inner or ''}{text}" + (f"</{tag}>" if r.random() < 0.85 or tag.startswith("h") or tag == "div" else ""))
            labels.append(label)

        def opened(tag, *names):
            if named == "tags":
                out.append(f"<{tag}" + (f' class="{pick(names)}"' if r.random() < 0.4 else "") + ">")
                return f"</{tag}>"
            attribute = {"names": f' {pick(("class", "class", "id"))}="{pick(names)}{pick(("", "-box", "-" + pick(words)[:5].replace(chr(34), "")))}"',
                         "none": pick(("", f' class="x{int(r.integers(99))}"'))}[named]
            out.append(f"<div{escape(attribute, quote=False)}>")
            return "</div>"

        def furniture():
            return pick(FURNITURE) if r.random() < 0.5 else say(1, 4)

        def links(k, tag="ul"):
            out.append(f"<{tag}>")
            for _ in range(k):
                put(f'<a href="/{int(r.integers(999))}">{furniture()}</a>', 0.0, "li")
            out.append(f"</{tag}>")

        def small(tag, *names, most=12):
            end = opened(tag, *names)
            for _ in range(int(r.integers(1, 3))):
                put(furniture() if r.random() < 0.6 else say(3, most), 0.0, pick(("p", "p", "div")))
            out.append(end)

        def advert():
            # Adverts keep a telling name mostly, even where nothing else has one.
            out.append(f'<{pick(("div", "section", "aside"))} class="{pick(("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"))}">')
            at = out[-1].split()[0][1:]
            put(say(3, 25), 0.0, pick(("p", "div")))
            out.append(f"</{at}>")

        def form():
            out.append("<form" + pick(("", ' class="newsletter"', ' id="search"', ' action="/login"')) + ">")
            for _ in range(int(r.integers(1, 4))):
                put(furniture(), 0.0, pick(("p", "div", "legend")))
            out.append("</form>")

        def remarks():
            end = opened(pick(("section", "div", "ol")), "comments", "comment-list", "replies", "disqus")
            if r.random() < 0.6:
                put(pick(("Comments", "Replies", "Leave a reply")), 0.0, pick(("h2", "h3")))
            for _ in range(int(r.integers(1, 6))):
                out.append(f'<{(at := pick(("div", "li", "article")))} class="{pick(("comment", "reply", "comment-body"))}">')
                for _ in range(int(r.integers(1, 3))):
                    put(say(2, 60), 0.0)
                out.append(f"</{at}>")
            out.append(end)

        def article():
            end = opened(pick(("article", "article", "main")), "content", "post", "entry", "article", "story", "main", "text", "body-text")
            if r.random() < 0.2:
                end = opened("div", "inner", "wrapper", "column") + end
            if r.random() < 0.8:
                put(say(2, 14), 1.0, "h1")
            for _ in range(int(np.exp(r.uniform(0, 3.4)))):
                u = r.random()
                if u < 0.74:
                    put(say(1, 120), 1.0, "p", pick(("", "", "", "<b>", "<br>", "<i>")))
                elif u < 0.8:
                    put(say(1, 8), 1.0, pick(("h2", "h3")))
                elif u < 0.85:
                    out.append(at := pick(("<ul>", "<ol>")))
                    for _ in range(int(r.integers(1, 6))):
                        put(say(1, 25), 1.0, "li")
                    out.append(at.replace("<", "</"))
                elif u < 0.88:
                    out.append("<blockquote>")
                    put(say(3, 60), 1.0)
                    out.append("</blockquote>")
                elif u < 0.91:
                    out.append("<table><tr>")
                    for _ in range(int(r.integers(1, 5))):
                        put(say(1, 5), 1.0, "td")
                    out.append("</tr></table>")
                elif u < 0.94:
                    put(f'{say(2, 30)} <a href="/x">{say(1, 6)}</a> {say(2, 30)}', 1.0)
                elif u < 0.96:
                    advert()
                elif u < 0.97:
                    form()
                elif u < 0.985:
                    small("aside", "related", "share", "social", "newsletter", "pullout-promo")
                else:
                    end_own = opened("nav", "pagination", "menu", "share")
                    links(int(r.integers(1, 5)))
                    out.append(end_own)
            if r.random() < 0.2:
                remarks()
            out.append(end)

        if r.random() < 0.25:
            small("div", "cookie", "consent", "notice", "cookie-notice", "popup")
        for make in r.permutation(np.array(["header", "nav", "advert", "notice", "crumbs"], object)):
            if r.random() < 0.55:
                if make == "header":
                    end = opened("header", "header", "masthead", "top", "site-header")
                    put(say(1, 4), 0.0, pick(("h1", "p", "div")))
                    out.append(end)
                elif make == "nav":
                    end = opened("nav", "nav", "menu", "navbar", "navigation", "main-menu")
                    links(int(r.integers(2, 12)))
                    out.append(end)
                elif make == "advert":
                    advert()
                elif make == "notice":
                    small("div", "notice", "alert", "consent", "announcement", "warning")
                else:
                    end = opened("nav", "breadcrumb", "breadcrumbs", "crumbs")
                    links(int(r.integers(1, 4)), "ol")
                    out.append(end)
        article()
        for make in r.permutation(np.array(["remarks", "aside", "form", "advert", "related"], object)):
            if r.random() < 0.35:
                if make == "remarks":
                    remarks()
                elif make == "aside":
                    end = opened("aside", "sidebar", "aside", "widget", "rail")
                    put(furniture(), 0.0, "h3")
                    links(int(r.integers(1, 8)))
                    if r.random() < 0.4:
                        put(say(2, 30), 0.0)
                    out.append(end)
                elif make == "form":
                    form()
                elif make == "advert":
                    advert()
                else:
                    end = opened("section", "related", "recommended", "more", "popular")
                    put(furniture(), 0.0, pick(("h2", "h3")))
                    links(int(r.integers(1, 6)))
                    out.append(end)
        if r.random() < 0.85:
            end = opened("footer", "footer", "foot", "bottom", "copyright", "site-footer")
            for _ in range(int(r.integers(1, 4))):
                put(pick(("&copy; ", "", "")) + (furniture() if r.random() < 0.5 else say(2, 12)), 0.0, pick(("p", "div")))
            out.append(end)
        return "".join(out), labels

    pages, marks = [], []
    while len(pages) < n:
        html, labels = page()
        blocks = leaves(html)
        if len(blocks) == len(labels):
            pages.append(blocks)
            marks.append(labels)
    return pages, marks


#: Pages of the table that the network learns from, the longest text of one, and layouts drawn besides.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 150, 40_000, 450


def fitted(pages: DataFrame, html: str = "html", sample: int = SAMPLE, drawn: int = LAYOUTS) -> dict[str, np.ndarray]:
    """Weights from at most `sample` pages of at most SAMPLE_CHARS characters, those whose texts' hashes are smallest, and `drawn` layouts."""
    few = pages.select(F.col(html).alias("h")).where(F.length("h") <= SAMPLE_CHARS).withColumn("x", F.xxhash64("h"))
    most = few.select("x").distinct().orderBy("x").limit(sample).agg(F.max("x")).first()[0]
    own = [r.h for r in few.where(F.col("x") <= most).groupBy("x").agg(F.min("h").alias("h")).orderBy("x").collect()] if most is not None else []
    seen = [leaves(h) for h in own]
    words = sorted({w for page in seen for b in page for w in b.text.split()[:50]})[:5000]
    drawn_pages, marks = layouts(drawn, words, 7)
    return learnt([*seen, *drawn_pages], [*map(landmarks, seen), *marks])


# ---- the table --------------------------------------------------------------------------

def article_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """key, url, text, n_chars and n_blocks (blocks of the whole page) of every page.

    text joins the blocks that the network labels as article by empty lines, in page order; n_chars are its code points. A null or empty page, and one without
    any block, has an empty text. Null and repeated keys are pages of their own, keys may be of any type, other columns are not read. An empty table gives an
    empty table. Without `weights` they are fitted first; for a table without pages, from layouts alone. Blocks are never cut, however long.
    """
    weights = fitted(pages, html) if weights is None else weights
    rows = pages.select(key, url, html)
    schema = with_columns(rows, [key, url], "text string, n_chars long, n_blocks long")

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            at = 0
            while at < len(texts):  # pages of about 4 MB at once, or one page
                own, size, first = [], 0, at
                while at < len(texts) and (at == first or size < 1 << 22):
                    h = texts[at].as_py() or ""
                    size += len(h)
                    own.append(leaves(h))
                    at += 1
                odds, k, found = scores(weights, own), 0, []
                for page in own:
                    found.append("\n\n".join(b.text for b, s in zip(page, odds[k:k + len(page)]) if s > 0))
                    k += len(page)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), batch.column(1).slice(first, at - first), pa.array(found, pa.string()),
                                                  pa.array([len(t) for t in found], pa.int64()), pa.array([len(p) for p in own], pa.int64())],
                                                 [key, url, "text", "n_chars", "n_blocks"])

    return rows.mapInArrow(run, schema)
