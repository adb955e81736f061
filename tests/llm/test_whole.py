"""Nothing is lost to shortcuts: results with and without them, and rows that they would drop."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from eventloom.llm import html, pii, simhash, toxicity
from eventloom.llm.common import Texts


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane @ example.com soon", "email", "jane @ example.com"),
        ("jane@example[.]com", "email", "jane@example[.]com"),
        ("see 1O2.16.3.4", "ip", "1O2.16.3.4"),
        ("plus one oh one oh one oh one oh one", "phone", "plus one oh one oh one oh one oh one"),
    ],
)
def test_pii_gate_lets_disguises_through(text, kind, found):
    spans = [(pii.KINDS[k], text[a:b]) for a, k, b, own in next(pii.block_spans(Texts(pa.array([text])))) if not own]
    assert spans == [(kind, found)]


def test_pii_gate_equals_no_gate():
    r = random.Random(8)
    bits = ["jane", "x", "@", " @ ", "@ ", "[.]", " dot ", " (dot) ", "[at]", " AT ", ".", ".com", "1", "O", "l", "1O2", "10.", "4111", " ", "-", "one ", "oh-", "Six, ", "ſix ", "fıve ", "plus ", "+", "(", "е", "\n", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 16))) for _ in range(40000)]
    texts += [".".join(r.choice(["1O2", "16", "3", "l1", "1l1"]) for _ in range(4)) for _ in range(500)]
    hidden = 0
    for t, got in zip(texts, pii.block_spans(Texts(pa.array(texts)))):
        base = pii.identifiers(t)
        want = sorted([(*x, True) for x in base] + pii.rewritten(t, base))
        assert got == want, t
        hidden += any(not s[3] for s in got)
    assert hidden > 500


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><article><p>one</p><svg class="icon"/><p>two</p><svg><path/></svg><p>three</p></article></body>', ["one", "two", "three"]),
        ('<body><article><p>one</p><svg class="icon"/><p>two</p></article></body>', ["one", "two"]),
        ("<article><p>before <button>Share<p>after</p></article>", ["before", "after"]),
        ("<div><p>a</p><object data=x><p>b</p><object><p>no</p></object><p>c</p></div>", ["a", "b", "c"]),
        ("<div>a <canvas></div>b", ["a", "b"]),
        ("<div>a <select><option>no</div><div>b</div>", ["a", "b"]),
        ("<p>a</p><template><b>no</b><p>b</p><svg><path><p>c</p>", ["a", "b", "c"]),
        ("<div>kept <object data=x>", ["kept"]),
        ("<p>a <button><div>no</div><!-- </button> --><p>no</p></button> b</p>", ["a b"]),
    ],
)
def test_html_open_and_self_closed_elements(page, want):
    assert [t for t in html.Page(page).text if t] == want


def test_toxicity_reads_long_clauses_whole():
    words = [f"word{i}" for i in range(500)]
    text = " ".join(["he", "said", *words, "you", "idiot", *words])
    x = toxicity.features(Texts(pa.array([text])), toxicity.Lexicon([], []), toxicity.Grammar(), toxicity.GIVEN)
    assert [m for m, n in zip(toxicity.MATCHES, x[0]) if n] == [("insult", True, "reported")]


def test_toxicity_rare_stems_among_many(spark):
    r = random.Random(3)
    many = " ".join("".join(r.choice("abcdefghijklm") for _ in range(9)) for _ in range(8000))
    toxic = [f"{many} {i}" for i in range(30)] + [f"zqxv {i}" for i in range(10)]
    clean = [f"{many} clean {i}" for i in range(120)] + [f"plain {i}" for i in range(240)]
    rows = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, y int")
    stems, suspects = toxicity.learn_stems(rows)
    assert any("zqxv".startswith(s.rstrip("$")) for s in stems + suspects)


def test_keep_one_tells_rows_apart(spark):
    r = random.Random(5)
    a, b, c, d, e = (" ".join(r.choice("abcdefghijklmnop") * 3 + str(r.randrange(99)) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (1, e), (2, e), (None, e), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.text or "") for x in kept) == sorted([("None", a), ("None", b), ("7", c), ("7", d), ("1", e), ("None", "")])
