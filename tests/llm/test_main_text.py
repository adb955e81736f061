"""Main text of pages by hand-written layouts that the trees were not trained on."""

from __future__ import annotations

import json
import random
from html import escape, unescape
from importlib import resources

import numpy as np
import pytest

from eventloom.llm import boosting, html

WORDS = "river stone market window people again after often letter carries morning small between water history report under music garden twenty street question answer table simple early north winter paper engine yellow moved never toward public school field open letters bright remain office".split()
FIELD = "Write to us, share what you think, or subscribe to the weekly letter of our house".split()


class Layouts:
    """Pages after the manner of sites; every article block is noted in `kept`."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kept: list[str] = []

    def words(self, lo: int, hi: int) -> str:
        s = " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(lo, hi)))
        return s[0].upper() + s[1:] + self.r.choice([".", ".", "", "?"])

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return escape(text)

    def body(self, n: int) -> str:
        out = []
        for _ in range(n):
            x = self.r.random()
            if x < 0.7:
                out.append(f"<p>{self.keep(self.words(6, 90))}</p>")
            elif x < 0.85:
                out.append(f"<h2>{self.keep(self.words(1, 6))}</h2>")
            elif x < 0.93:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.words(2, 14))}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<blockquote><p>{self.keep(self.words(8, 30))}</p></blockquote>")
        return "".join(out)

    def menu(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in self.r.sample(WORDS, n)) + "</ul>"

    def junk(self) -> str:
        return escape(self.words(2, 25))

    def news(self) -> str:
        r = self.r
        top = f'<header class="site-header"><div class="logo">{self.junk()}</div><nav>{self.menu(6)}</nav></header>'
        main = f'<main><article class="story"><h1>{self.keep(self.words(3, 12))}</h1>{self.body(r.randint(3, 14))}</article><aside class="related"><h3>Related</h3>{self.menu(4)}</aside></main>'
        return f'{top}{main}<section id="comments"><h3>Comments</h3>' + "".join(f'<div class="comment"><p>{self.junk()}</p></div>' for _ in range(r.randint(1, 5))) + f"</section><footer><p>&copy; 2021 {self.junk()}</p></footer>"

    def blog(self) -> str:
        r = self.r
        post = f'<div class="post"><h1>{self.keep(self.words(2, 9))}</h1><div class="entry-content">{self.body(r.randint(2, 10))}</div></div>'
        side = f'<div class="sidebar"><div class="widget"><h4>Search</h4><form><input type="text"><button>Go</button></form></div><div class="widget"><h4>Archive</h4>{self.menu(5)}</div></div>'
        return f'<div id="header"><p><a href="/">{self.junk()}</a></p></div><div id="wrap">{post}{side}</div><div id="footer">{self.junk()}</div>'

    def manual(self) -> str:
        return f'<nav class="toc">{self.menu(8)}</nav><main id="content"><h1>{self.keep(self.words(1, 5))}</h1>{self.body(self.r.randint(4, 12))}</main><footer>{self.junk()}</footer>'

    def cookie(self) -> str:
        return f'<div class="cookie-banner"><p>We use cookies. {self.junk()}</p><button>Accept</button></div><div class="content"><h1>{self.keep(self.words(2, 8))}</h1>{self.body(self.r.randint(2, 8))}<div class="ad">{self.junk()}</div>{self.body(self.r.randint(1, 4))}</div><div class="newsletter"><form><p>{" ".join(FIELD)}</p><input name="e"><button>Send</button></form></div>'

    def plain(self) -> str:
        return f"<h1>{self.keep(self.words(1, 8))}</h1>" + "".join(f"<p>{self.keep(self.words(1, 60))}</p>" for _ in range(self.r.randint(1, 8)))

    def spans(self) -> str:
        return "".join(f"<div><span>{self.keep(self.words(2, 40))}</span></div>" for _ in range(self.r.randint(1, 8)))

    def table(self) -> str:
        return f'<table><tr><td width="120">{self.menu(6)}</td><td><h1>{self.keep(self.words(2, 6))}</h1>' + "".join(f"<p>{self.keep(self.words(8, 70))}</p>" for _ in range(self.r.randint(2, 8))) + "</td></tr></table>"


NAMES = ("news", "blog", "manual", "cookie", "plain", "spans", "table")


@pytest.mark.parametrize("name", NAMES)
def test_layouts(name):
    trees, got, want, exact = html.model(), 0, 0, 0
    hits = 0
    for seed in range(60):
        made = Layouts(1000 + seed)
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{getattr(made, name)()}</body></html>"
        found = html.extract([page], trees)[0].split("\n")
        kept = [unescape(k) for k in made.kept]
        left = list(kept)
        for block in found:
            if block in left:
                left.remove(block)
                hits += 1
        got, want, exact = got + len(found), want + len(kept), exact + (found == kept)
    assert hits / want >= 0.99, ("recall", hits / want)
    assert hits / got >= 0.98, ("precision", hits / got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><body><p>A A</p><p>A</p></body></html>", "A A\nA"),
        ("<body><div><span>one</span></div><div><span>two</span></div></body>", "one\ntwo"),
        (f"<h1>T</h1><p>First line<br>Second line</p><p>{'long ' * 60}</p>", "T\nFirst line Second line\n" + ("long " * 60).strip()),
        (f"<body><article><h1>T</h1><nav><a>Next</a></nav><p>{'text here ' * 20}</p></article></body>", "T\n" + ("text here " * 20).strip()),
        (f"<table><tr><td><a href=/>Home</a> <a href=/a>About</a></td><td><p>{'words of it, ' * 30}</p><p>more</p></td></tr></table>", ("words of it, " * 30).strip() + "\nmore"),
        (f"<form><article><h1>T</h1><p>{'text here ' * 20}</p></article></form>", "T\n" + ("text here " * 20).strip()),
        ("only words", "only words"),
        ("<nav><a>Home</a></nav><footer>f</footer>", ""),
        ("", ""),
    ],
)
def test_small_pages(page, want):
    assert html.extract([page], html.model()) == [want]


def test_file_holds_what_training_gives():
    held = json.loads(resources.files("eventloom.llm").joinpath(html.FILE).read_text())
    again = html.train()
    x = html.features([html.Page(f"<body>{Layouts(s).news()}</body>") for s in range(20)])
    assert np.allclose(boosting.Trees.load(held).predict(x), again.predict(x))


def test_name_clash_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "<p>one</p>", "mine"), (2, None, "mine"), (2, "", None)], "page_id long, html string, text string")
    got = html.main_text(rows)
    assert got.columns == ["page_id", "html", "text", "text_"]
    assert sorted((r.page_id, r.text or "", r.text_) for r in got.collect()) == [(1, "mine", "one"), (2, "", ""), (2, "mine", "")]
    assert html.main_text(rows.limit(0)).count() == 0
