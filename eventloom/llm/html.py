"""Main text of web pages: boosted trees score the nodes of a page, and a decoding over its tree picks what stays.

Nodes are the block elements of a page and the text blocks between them, in page order, so a subtree is a range
and its sums are differences of prefix sums. Features are densities of the subtree (words, links, paragraphs,
punctuation, form controls), tokens of class, id and role on the node and above it, depth, siblings, and place. The
trees are trained on made pages of many layouts, with and without elements around the article, from a fixed seed;
texts are alike in articles and around them, and nothing is learned from the pages that are read. `python -m
eventloom.llm.html` trains them and writes the file that model() reads.

Decoding is hierarchical: a node that goes takes all below it along, so what stays is a tree from the root, and
the one with the greatest sum of log-probabilities is taken (a node's best is the better of "all of it goes" and
"it stays, and each child its best"). Elements that by their name are never an article's (NEVER) always go, and so
does a form that does not hold most of its page. Text blocks that stay are the page's text.

Null and empty pages have an empty text. Nothing is dropped or cut inside a block that stays. A page's text depends
on that page alone.
"""

from __future__ import annotations

import functools
import json
import random
import re
from html import unescape
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm import boosting
from eventloom.llm.common import Texts, with_columns

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRS = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# What HTML says of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea select button iframe object svg canvas title head".split())
RAW = frozenset("script style textarea title iframe noscript template svg".split())
#: Of skipped ones, those whose end tag may be missing without all that follows being theirs (HTML reads on to the end in the others).
LOOSE = frozenset("noscript template select button object svg canvas".split())
CONTROLS = frozenset("input select textarea button label option".split())
#: A start tag of these closes an open one of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table".split())

GROUPS = {
    t: k
    for k, names in enumerate(("div section body html center", "article main", "p pre blockquote", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tr td th", "nav", "header", "footer", "aside", "form fieldset label dialog", "figure figcaption"))
    for t in names.split()
}
N_GROUPS = 14
#: Groups that never belong to an article: nav, footer, aside. Forms neither, unless most of the page is in one.
NEVER, FORM = (7, 9, 10), 11
# Tokens of class, id and role that tell what a part of a page is for.
TOKENS = {
    t: k
    for k, names in enumerate(
        (
            "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar",
            "header masthead banner branding logo site",
            "footer foot bottom copyright legal colophon contentinfo",
            "sidebar side aside widget related recommended popular trending recent archive tags rail secondary complementary",
            "ad ads advert advertisement advertisements sponsor sponsored promo promotion promoted adsense banner outbrain taboola",
            "notice cookie cookies consent gdpr popup modal overlay alert warning dialog message announcement toast paywall",
            "comment comments respond reply replies discussion disqus thread feedback",
            "form login signin signup register search subscribe subscription newsletter contact field",
            "share sharing social follow meta byline author tools toolbar print rating",
            "article content post entry story main body text prose page blog news",
        )
    )
    for t in names.split()
}
N_TOKENS = 10
_GOOD = 1 << 9

_TELLING = re.compile(r"©|\b(?:cookies?|subscri|newsletter|copyright|rights reserved|sign ?(?:up|in)\b|log ?in\b|share\b|comments?\b|repl(?:y|ies)\b|advert|sponsor|read more|related|search\b|privacy|terms\b)", re.I)


@functools.lru_cache(1 << 14)
def _tokens(attrs: str) -> int:
    mask = 0
    for m in _ATTRS.finditer(attrs):
        for part in _PARTS.findall(m[1] or m[2] or m[3] or ""):
            k = TOKENS.get(part.lower())
            if k is not None:
                mask |= 1 << k
    return mask

def _ended(html: str, tag: str) -> set[int]:
    """Where those start tags of an element stand that an end tag belongs to."""
    out: set[int] = set()
    open_: list[int] = []
    for m in re.finditer(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b.*?(?:</\1\b|\Z)|<(/?){tag}(?=[\s/>])((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""", html, re.I | re.S):
        if m[2] and open_:
            out.add(open_.pop())
        elif m[2] == "" and not m[3].endswith("/"):
            open_.append(m.start())
    return out


class Page:
    """The nodes of a page, in page order. Text blocks have a text, elements None."""

    def __init__(self, html: str):
        self.parent: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.group: list[int] = []
        self.mask: list[int] = []
        self.above: list[int] = []  # groups above
        self.masks: list[int] = []  # tokens above
        self.text: list[str | None] = []
        self.links: list[int] = []  # characters in links
        self.n_links: list[int] = []
        self.controls: list[int] = []
        self._read(html)

    def _open(self, tag: str, parent: int, mask: int, text: str | None = None) -> int:
        k = len(self.parent)
        self.parent.append(parent)
        self.end.append(k + 1)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(GROUPS.get(tag, 13))
        self.mask.append(mask)
        self.above.append(self.above[parent] | 1 << self.group[parent] if parent >= 0 else 0)
        self.masks.append(self.masks[parent] | self.mask[parent] if parent >= 0 else 0)
        self.text.append(text)
        self.links.append(0)
        self.n_links.append(0)
        self.controls.append(0)
        return k

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("html", self._open("html", -1, 0))]
        held: list[str] = []
        linked = 0  # characters of the held text in links
        n_links = 0
        link = -1  # how deep the open link stands, if there is one
        skip: list[str] = []
        loose: list[bool] = []  # of each in skip, whether its end tag is missing
        ended: dict[str, set[int]] = {}
        pos, size = 0, len(html)

        def flush() -> None:
            nonlocal held, linked, n_links
            if held:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    tag, node = stack[-1]
                    k = self._open(tag, node, 0, text)
                    self.links[k], self.n_links[k] = min(linked, len(text)), n_links
                held, linked, n_links = [], 0, 0

        def close(depth: int) -> None:
            nonlocal link
            while len(stack) > depth:
                self.end[stack.pop()[1]] = len(self.parent)
            if link > len(stack):
                link = -1

        def endless(tag: str, start: int) -> bool:
            if tag not in LOOSE:
                return False
            if tag not in ended:
                ended[tag] = _ended(html, tag)
            return start not in ended[tag]

        while pos < size:
            m = _TOKEN.search(html, pos)
            start = m.start() if m else size
            if start > pos and not skip:
                chunk = html[pos:start]
                held.append(chunk)
                if link >= 0:
                    linked += len(chunk.strip())
            if not m:
                break
            pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                if not skip and html.startswith("<![CDATA[", start):
                    held.append(html[start + 9 : pos - 3].replace("&", "&amp;"))
                continue
            tag = tag.lower()
            closing = (m[1] or m[4]) == "/"
            if skip and loose[-1] and (any(t == tag for t, _ in stack[1:]) if closing else tag in GROUPS):
                # What has no end tag ends where a block starts, or where what it stands in ends.
                while skip and loose[-1]:
                    skip.pop()
                    loose.pop()
            if skip:
                if tag in SKIPPED and tag not in VOID:
                    if closing:
                        if tag in skip:
                            del skip[len(skip) - 1 - skip[::-1].index(tag) :]
                            del loose[len(skip) :]
                    elif not (m[3] or m[6] or "").endswith("/"):
                        skip.append(tag)
                        loose.append(endless(tag, start))
                elif tag == "body" or (not closing and skip == ["head"] and tag not in ("meta", "link", "base")):
                    skip.clear()  # a head that is not closed
                    loose.clear()
                else:
                    continue
                if skip or closing or tag in SKIPPED:
                    continue
            if closing:
                if tag == "a":
                    link = -1
                elif tag in INLINE:
                    pass
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            flush()
                            close(i)
                            break
                    else:
                        flush()
                continue
            attrs = m[3] or m[6] or ""
            if tag in CONTROLS:
                self.controls[stack[-1][1]] += 1
            if tag in RAW and not (tag == "svg" and attrs.endswith("/")) and not endless(tag, start):
                close_at = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
                pos = close_at.end() if close_at else size
                held.append(" ")
                continue
            if tag in SKIPPED:
                if not attrs.endswith("/"):
                    skip.append(tag)
                    loose.append(endless(tag, start))
                held.append(" ")
                continue
            if tag in INLINE:
                if tag == "a":
                    link = len(stack)
                    n_links += 1
                elif tag in ("br", "img"):
                    held.append(" ")
                continue
            flush()
            if tag in VOID or tag in ("html", "body") and tag == "html":
                continue
            # A start tag of a block ends an open paragraph; items end items.
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in LISTS:
                        break
            node = self._open(tag, stack[-1][1], _tokens(attrs) if attrs else 0)
            if not attrs.endswith("/"):
                stack.append((tag, node))
        flush()
        close(0)


def features(pages: list[Page]) -> np.ndarray:
    """A row for each node of all pages."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate(([0], np.cumsum(sizes)))
    base = np.repeat(first[:-1], sizes)
    n = int(first[-1])

    def column(name: str) -> np.ndarray:
        return np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, n)

    parent = column("parent")
    top = parent < 0
    up = np.where(top, np.arange(n), parent + base)
    end = column("end") + base
    at = np.arange(n)
    group, mask, above, masks = column("group"), column("mask"), column("above"), column("masks")
    texts = [t for p in pages for t in p.text]
    leaf = np.array([t is not None for t in texts])
    chars = np.array([len(t) if t else 0 for t in texts])
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    marks = np.array([t.count(",") + t.count(".") if t else 0 for t in texts])
    ends = np.array([bool(t) and t[-1] in ".!?:\"'”»" for t in texts])
    telling = np.array([bool(t) and len(t) < 300 and bool(_TELLING.search(t)) for t in texts])

    def subtree(x: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(x)))
        return c[end] - c[at]

    c, w, k = subtree(chars), subtree(words), subtree(leaf)
    page = np.repeat(np.arange(len(pages)), sizes)
    total = c[first[:-1]][page]
    before = np.concatenate(([0], np.cumsum(chars)))[at] - np.concatenate(([0], np.cumsum(chars)))[base]
    # Siblings: nodes in order of parent, then place.
    order = np.lexsort((at, up))
    order = order[~top[order]]
    new = np.concatenate(([True], up[order][1:] != up[order][:-1])) if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(order)))
    index, siblings = np.zeros(n), np.ones(n)
    index[order] = np.arange(len(order)) - np.repeat(heads, count)
    siblings[order] = np.repeat(count, count)
    prior, later = np.zeros(n), np.zeros(n)
    if len(order):
        prior[order[1:]] = np.where(new[1:], 0, c[order[:-1]])
        later[order[:-1]] = np.where(new[1:], 0, c[order[1:]])
    lg = np.log1p
    bits = lambda x, ks: [(x >> k) & 1 for k in ks]
    in_tokens = np.zeros(n)
    for b in range(N_TOKENS - 1):
        in_tokens += (masks >> b) & 1
    columns = [
        leaf, column("depth"), index, siblings, index / siblings,
        *bits(1 << group, range(N_GROUPS)), *bits(above, range(N_GROUPS)), *bits(mask, range(N_TOKENS)), *bits(masks, range(N_TOKENS)), in_tokens,
        *bits(1 << group[up], (0, 1, 4, 6)), *bits(mask[up], (3, 9)),
        lg(c), lg(w), w / (k + 1e-9), c / (total + 1), subtree(column("links")) / (c + 1), lg(subtree(column("n_links"))), subtree(column("n_links")) / (k + 1e-9),
        lg(subtree((group == 2) & leaf)), lg(subtree((group == 3) & leaf)), lg(subtree((group == 5) & leaf)), subtree((group == 2) & leaf) / (k + 1e-9),
        lg(subtree(column("controls"))), subtree(marks) / (w + 1), subtree(ends) / (k + 1e-9), subtree(telling) / (k + 1e-9), lg(k),
        before / (total + 1), lg(prior), lg(later), c / (c[up] + 1), lg(c[up]), lg(total),
        subtree((group == 1) & ~leaf) > 0, subtree((group == 1) & ~leaf)[first[:-1]][page] > 0,
        lg(k)[first[:-1]][page], (subtree(column("links")) / (c + 1))[first[:-1]][page], subtree((group == 3) & leaf)[first[:-1]][page] > 0,
        c / (np.maximum.reduceat(np.where(leaf, chars, 0), first[:-1])[page] + 1),
    ]
    return np.stack([np.asarray(x, np.float32) for x in columns], axis=1)


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """The text blocks of the best tree from the root, which itself always stays."""
    n = len(page.parent)
    stay = -np.logaddexp(0, -odds)
    go = -np.logaddexp(0, odds)
    below = np.concatenate(([0], np.cumsum(go))).tolist()
    stay = stay.tolist()
    keeps = [False] * n
    best = [0.0] * n  # of the children so far
    size = np.concatenate(([0], np.cumsum([len(t) if t else 0 for t in page.text]))).tolist()
    for v in range(n - 1, -1, -1):
        out, kept = below[page.end[v]] - below[v], stay[v] + best[v]
        group = page.group[v]
        if page.text[v] is None and (group in NEVER or (group == FORM and 2 * (size[page.end[v]] - size[v]) <= size[-1])):
            kept = -np.inf
        keeps[v] = kept > out or not v
        if page.parent[v] >= 0:
            best[page.parent[v]] += max(kept, out)
    found, v = [], 0
    while v < n:
        if not keeps[v]:
            v = page.end[v]
            continue
        if page.text[v] is not None:
            found.append(page.text[v])
        v += 1
    return found


# ---------------------------------------------------------------- made pages to train on

_IN, _OUT = "", ""


class Maker:
    """Makes pages; every text block begins with a sign that says if it is part of the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("bcdfghlmnprst") + self.r.choice("aeiouéäó") for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def some(self, *options):
        return self.r.choice(options)

    def maybe(self, p: float, f, *a) -> str:
        return f(*a) if self.r.random() < p else ""

    def say(self, lo: int, hi: int) -> str:
        r = self.r
        out = [r.choice(self.words) for _ in range(max(1, int(lo * (hi / lo) ** r.random())))]
        style = r.random()
        if style < 0.08:
            out = [w + r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;&amp;"]) for w in out]
        elif style < 0.12:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.15:
            out = [x for w in out for x in (w, "|")]
        else:
            for i in range(len(out)):
                if r.random() < 0.12:
                    out[i] += r.choice([",", ".", "."])
        return (" ".join(out)).capitalize() + r.choice([".", ".", ".", ""])

    def attrs(self, *tokens: str, p: float = 0.85) -> str:
        r = self.r
        if not tokens or r.random() > p:
            return self.some("", "", f' class="{self.some("box", "wrap", "row", "col-8", "inner", "block", "c12", "grid")}"')
        t = r.choice(tokens)
        t = self.some(t, t, f"{t}-{self.some('box', 'wrap', 'area', 'inner', 'list', 'container')}", f"{self.some('main', 'site', 'page', 'top', 'left')}-{t}" if t not in ("content", "article") else t)
        return f' {self.some("class", "class", "id")}="{t}"'

    def block(self, tag: str, inner: str, *tokens: str, p: float = 0.85) -> str:
        return f"<{tag}{self.attrs(*tokens, p=p)}>{inner}</{tag}>"

    def link(self, sign: str, lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{sign}{self.say(lo, hi)}</a>'

    def items(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link(_OUT)}</li>" for _ in range(n)) + "</ul>"

    def links(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        return self.some(self.items(n), self.items(n), f"<p>{_OUT}" + " | ".join(f'<a href="/">{self.say(1, 2)}</a>' for _ in range(n)) + "</p>", "".join(f"<div>{self.link(_OUT)}</div>" for _ in range(n)))

    def nav(self) -> str:
        return self.some(self.block("nav", self.links(2, 9), "nav", "menu", p=0.5), self.block("div", self.links(3, 9), "nav", "menu", "navbar", "breadcrumbs", p=0.9), self.block("nav", self.items(self.r.randint(3, 8)), p=0))

    def head(self) -> str:
        inner = self.some(f"<h1>{_OUT}{self.say(1, 4)}</h1>", f"<div>{_OUT}{self.say(1, 3)}</div><p>{_OUT}{self.say(2, 9)}</p>", f"<p>{self.link(_OUT)}</p>", f"{_OUT}{self.say(1, 5)}") + self.maybe(0.5, self.nav)
        return self.some(self.block("header", inner, "header", "masthead", p=0.5), self.block("div", inner, "header", "masthead", "banner", "branding"))

    def foot(self) -> str:
        words = _OUT + self.some("&copy; ", "Copyright ", "", "&copy; 2020 &middot; ") + self.say(2, 30)
        inner = self.some(words, f"<p>{words}</p>", f"<p>{words}</p>" + self.links(2, 6), f"<div>{words}</div><p>{_OUT}{self.say(3, 30)}</p>")
        return self.some(self.block("footer", inner, "footer", p=0.4), self.block("footer", inner, p=0), self.block("div", inner, "footer", "copyright", "bottom", "legal"))

    def side(self) -> str:
        inner = "".join(self.block("div", f"<h3>{_OUT}{self.say(1, 4)}</h3>" + self.some(self.links(2, 7), f"<p>{_OUT}{self.say(5, 60)}</p>", f"<p>{_OUT}{self.say(5, 30)} {self.link('')}</p>"), "widget", "box", p=0.6) for _ in range(self.r.randint(1, 3)))
        return self.some(self.block("aside", inner, "sidebar", "related", p=0.6), self.block("div", inner, "sidebar", "side", "related", "rail", "popular"))

    def advert(self) -> str:
        inner = self.some(f"{_OUT}{self.say(3, 40)}", f"<p>{_OUT}{self.say(3, 40)}</p>", f"<p>{self.link(_OUT, 2, 10)}</p>", f"<h4>{_OUT}{self.say(2, 6)}</h4><p>{_OUT}{self.say(4, 30)}</p>")
        return self.block(self.some("div", "div", "div", "section", "aside"), inner, "ad", "ads", "advert", "sponsored", "promo", "advertisement", p=0.97)

    def notice(self) -> str:
        inner = self.some(f"{_OUT}{self.say(4, 50)}", f"<p>{_OUT}{self.some('', 'We use cookies ', 'Warning ')}{self.say(4, 50)}</p>") + self.maybe(0.4, lambda: "<button>OK</button>")
        return self.block(self.some("div", "div", "section", "aside", "p"), inner, "notice", "cookie", "consent", "alert", "popup", "modal", "announcement", p=0.97)

    def form(self) -> str:
        inner = f"<p>{_OUT}{self.some('Subscribe ', 'Search ', 'Sign up ', '')}{self.say(2, 20)}</p><label>{_OUT}{self.say(1, 3)}</label><input type=\"text\"><button>{self.say(1, 2)}</button>"
        return self.some(self.block("form", inner, "search", "login", "subscribe", p=0.5), self.block("div", f"<form>{inner}</form>", "newsletter", "subscribe", "search", "signup"))

    def comments(self) -> str:
        r = self.r
        one = lambda: self.some(f"<p>{_OUT}{self.say(4, 80)}</p>", f"<div>{_OUT}{self.say(1, 3)}</div><p>{_OUT}{self.say(4, 80)}</p><p>{_OUT}{self.say(4, 60)}</p>", f"{_OUT}{self.say(4, 80)}")
        n = r.randint(1, 8)
        title = self.maybe(0.6, lambda: f"<h3>{_OUT}{self.some('Comments', 'Replies', self.say(1, 3))}</h3>")
        inner = self.some("".join(self.block("div", one(), "comment", "reply", p=0.8) for _ in range(n)), "<ol>" + "".join(self.block("li", one(), "comment", p=0.6) for _ in range(n)) + "</ol>", "".join(self.block("article", one(), "comment", p=0.95) for _ in range(n)), "".join(f"<p>{_OUT}{self.say(4, 80)}</p>" for _ in range(n)))
        return self.block(self.some("div", "section", "section", "aside", "ul"), title + inner + self.maybe(0.2, self.form), "comments", "comment", "discussion", "respond", "replies", p=0.97)

    def share(self) -> str:
        return self.block("div", self.some(self.links(2, 5), f"{_OUT}{self.say(1, 4)}"), "share", "social", "tools", "meta", p=0.95)

    def para(self) -> str:
        words = self.say(1, 120)
        if self.r.random() < 0.06:
            words = self.some("All rights reserved.", "Copyright is a word.", "Read more of it.", words + " share " + self.say(1, 9), "Licensed under terms " + self.say(1, 5), "Comments on cookies " + self.say(1, 30))
        if self.r.random() < 0.2:
            words += f' <a href="/x">{self.say(1, 4)}</a> {self.say(1, 20)}'
        return self.some(f"<p>{_IN}{words}</p>", f"<p>{_IN}{words}</p>", f"<p>{_IN}{words}", f"<p><b>{_IN}{words}<br>", f'<p class="{self.some("text", "lead", "x1")}">{_IN}{words}</p>')

    def piece(self, plain: str) -> str:
        x = self.r.random()
        if x < 0.72:
            return self.para() if plain == "p" else f"<div>{_IN}{self.say(3, 120)}</div>"
        if x < 0.8:
            h = self.some("h2", "h3", "h4")
            return f"<{h}>{_IN}{self.say(1, 9)}</{h}>"
        if x < 0.86:
            t = self.some("ul", "ol")
            return f"<{t}>" + "".join(f"<li>{_IN}{self.say(1, 25)}</li>" for _ in range(self.r.randint(2, 7))) + f"</{t}>"
        if x < 0.9:
            return self.some(f"<blockquote><p>{_IN}{self.say(4, 50)}</p></blockquote>", f"<blockquote>{_IN}{self.say(4, 50)}</blockquote>", f"<pre>{_IN}{self.say(4, 50)}</pre>")
        if x < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{_IN}{self.say(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if x < 0.95:
            return f'<figure><img src="x"><figcaption>{_IN}{self.say(2, 20)}</figcaption></figure>'
        return self.para() + self.some(self.advert, self.notice, self.advert, self.share, self.form)()

    def article(self) -> str:
        n = int(30 ** self.r.random())
        plain = "div" if self.r.random() < 0.1 else "p"
        title = f"<h1>{_IN}{self.say(1, 14)}</h1>"
        title = self.some(title, title, title, f"<header>{title}</header>", "")
        body = "".join(self.piece(plain) for _ in range(max(n, 1 if title else 2)))
        if self.r.random() < 0.3:
            body = self.block(self.some("div", "section"), body, "content", "body", "entry", "text", p=0.6)
        end = self.maybe(0.15, self.share) + self.maybe(0.1, self.comments) + self.maybe(0.05, self.foot) + self.maybe(0.04, self.nav) + self.maybe(0.03, self.side)
        return self.some(self.block("article", title + body + end, "post", "article", "entry", p=0.4), f"<article>{title}{body}{end}</article>", self.block("div", title + body + end, "content", "post", "article", "entry", "story", p=0.8), self.block("main", title + body + end, "content", p=0.3), self.block("section", title + body + end, "content", "story", p=0.5))

    def bare(self) -> str:
        """An article without an element of its own around it."""
        r = self.r
        n = int(12 ** r.random())
        title = self.maybe(0.4, lambda: (lambda h: f"<{h}>{_IN}{self.say(1, 12)}</{h}>")(self.some("h1", "h1", "h2")))
        short = r.random() < 0.3
        say = lambda: self.say(1, 8 if short else 120)
        kind = r.random()
        if kind < 0.35:
            body = "".join(f"<p>{_IN}{say()}" + self.some("</p>", "</p>", "") for _ in range(n))
        elif kind < 0.55:
            body = "".join(self.some(f"<div>{_IN}{say()}</div>", f"<div><span>{_IN}{say()}</span></div>") for _ in range(n))
        elif kind < 0.75:
            lines = self.some("<br>", "<br><br>", "<br/>\n").join(say() for _ in range(r.randint(1, 6)))
            rest = "".join(self.some(f"<p>{_IN}{say()}<br>{say()}</p>", f"<p>{_IN}{say()}</p>") for _ in range(r.randint(0, 4)))
            body = self.some(f"<p>{_IN}{lines}</p>", f"<div>{_IN}{lines}</div>", f"{_IN}{lines}") + rest
        elif kind < 0.88:
            cells = [f"<td>{self.links(2, 6)}</td>" if r.random() < 0.6 else "", f"<td>{title}" + "".join(f"<p>{_IN}{say()}</p>" for _ in range(n)) + "</td>", f"<td>{_OUT}{self.some('Home', self.say(1, 4))} {self.link('')} {self.link('')}</td>" if r.random() < 0.3 else ""]
            title, body = "", "<table><tr>" + "".join(cells) + "</tr></table>"
        else:
            body = "".join(self.piece("p") for _ in range(n))
        body = title + body
        return self.some(body, body, f"<div>{body}</div>", f'<div class="{self.some("wrap", "row", "inner", "c12")}">{body}</div>')

    def page(self) -> str:
        bare = self.r.random() < 0.3
        often = self.some(0, 0, 0.3, 1) if bare else 1
        before = [f() for f, p in ((self.notice, 0.15), (self.head, 0.4), (self.nav, 0.6), (self.advert, 0.4), (self.form, 0.12), (self.side, 0.15), (self.share, 0.05)) if self.r.random() < p * often]
        after = [f() for f, p in ((self.share, 0.12), (self.advert, 0.25), (self.comments, 0.35), (self.form, 0.15), (self.side, 0.3), (self.nav, 0.1), (self.notice, 0.1), (self.foot, 0.75)) if self.r.random() < p * often]
        self.r.shuffle(before)
        core = self.bare() if bare else self.article() if self.r.random() < 0.97 else ""
        if not bare and self.r.random() < 0.35:
            k = self.r.randint(0, len(after))
            core, after = self.block(self.some("div", "main", "section"), core + "".join(after[:k]), "main", "content", "wrapper", "page", p=0.6), after[k:]
        if self.r.random() < 0.08:  # sites that put all of a page in one form
            return self.some(f"<form>{''.join(before)}{core}{''.join(after)}</form>", f"{''.join(before)}<form>{core}</form>{''.join(after)}")
        return "".join(before) + core + "".join(after)


N_PAGES = 1000
FILE = "main_text_trees.json"


def train(n_pages: int = N_PAGES, seed: int = 20) -> boosting.Trees:
    """Trees trained on made pages; a node is kept if an article's text is below it."""
    maker = Maker(seed)
    pages, labels = [], []
    for _ in range(n_pages):
        p = Page(f"<html><body>{maker.page()}</body></html>")
        inside = np.array([bool(t) and _IN in t for t in p.text])
        p.text = [t.replace(_IN, "").replace(_OUT, "") if t else t for t in p.text]
        c = np.concatenate(([0], np.cumsum(inside)))
        labels.append(c[p.end] - c[:-1] > 0)
        pages.append(p)
    return boosting.fit(features(pages), np.concatenate(labels).astype(float))


@functools.lru_cache(1)
def model() -> boosting.Trees:
    """The trained trees, from the file beside this module; where that is missing they are trained again."""
    try:
        return boosting.Trees.load(json.loads(resources.files(__package__).joinpath(FILE).read_text()))
    except FileNotFoundError:
        return train()


def extract(pages: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page."""
    read = [Page(p) for p in pages]
    if not read:
        return []
    odds = trees.predict(features(read))
    out, at = [], 0
    for p in read:
        n = len(p.parent)
        out.append("\n".join(decode(p, odds[at : at + n])))
        at += n
    return out


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of each."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def each():
        trees = shared.value

        def of(texts: Texts) -> dict[str, pa.Array]:
            return {name: pa.array(extract([texts.bytes(i).decode() for i in range(texts.n)], trees), pa.string())}

        return of

    return with_columns(pages, html, T.StructType([T.StructField(name, T.StringType())]), each)


if __name__ == "__main__":
    from pathlib import Path

    Path(__file__).with_name(FILE).write_text(json.dumps(train().dump()) + "\n")
