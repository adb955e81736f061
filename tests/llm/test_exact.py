"""Equal hashes are not taken for equal texts, long texts take time in proportion, and queries agree with plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import string
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from eventloom.llm import chat, licenses, packing, pii, quality, toxicity
from eventloom.llm import queries as q
from eventloom.llm.common import Texts, span_ids
from eventloom.llm.decontaminate import Scanner, WindowSet, find_contamination

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def thue_morse(n: int) -> str:
    """Two of these with letters exchanged have one polynomial hash modulo 2**64."""
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_lines_and_words_are_compared_by_their_bytes(n):
    x = thue_morse(n)
    y = x.translate(str.maketrans("ab", "ba"))
    m = quality.measure(Texts(pa.array([f"{x}\n{y}", f"{x}\n{x}", f"{x} {y} q {y} {x} q"])))
    assert m["n_dup_lines"].to_pylist() == [0, 1, 0] and m["n_repeat_words"].to_pylist() == [0, 0, 0]


def test_equal_hashes_are_told_apart():
    buf = np.frombuffer(b"abcabdabc", np.uint8)
    ids = span_ids(buf, np.array([0, 3, 6]), np.array([3, 6, 9]), np.zeros(3, np.uint64))
    assert ids[0] == ids[2] != ids[1]


def brute_repeats_of(text: str, least: int) -> tuple[int, int, int]:
    w = SOLID.findall(text)
    covered, most = set(), 0
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            most = max(most, k)
            if k >= least:
                covered |= set(range(i, i + k))
    three = defaultdict(list)
    for i in range(len(w) - 2):
        three[tuple(w[i : i + 3])].append(i)
    return len(covered), len({x + k for at in three.values() if len(at) > 1 for x in at for k in range(3)}), most


@pytest.mark.parametrize("least", [2, 4])
def test_intervals_against_brute_force(least):
    r = random.Random(least)
    for _ in range(60):
        texts = [" ".join(r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 45))) for _ in range(4)]
        m = quality.measure(Texts(pa.array(texts)), least)
        assert list(zip(*(m[c].to_pylist() for c in ("covered_words", "n_repeat_words", "longest_repeat")))) == [brute_repeats_of(t, least) for t in texts]


def test_maximal_repeats_are_maximal():
    """Of "x a b c y a b c z": "a b c" is maximal, "b c" is not, for all of it stands in the longer one."""
    ids = np.array([0, 1, 2, 3, 4, 1, 2, 3, 5])
    doc = np.zeros(9, np.int64)
    start, size = quality.maximal_repeats(ids, doc, *quality.common_prefixes(ids, doc), 2)
    assert sorted(zip(start.tolist(), size.tolist())) == [(1, 3), (5, 3)]


# ---------------------------------------------------------------- 8

LONG = ["1" * 10**6, "a." * 500_000 + " dot", " at " * 250_000, " " * 10**6 + " dot", "a at" + " at (.)" * 140_000, "1." * 500_000, "a@" * 500_000, "a@a." * 250_000, "[ " * 500_000 + "dot", "plus " * 200_000 + " two", "+1" + "(" * 10**6, "4111 1111 1111 1111 x" * 50_000, "1.2.3.4 " * 125_000]


@pytest.mark.parametrize("text", LONG, ids=[f"{t[:6]!r}" for t in LONG])
def test_pii_time_grows_with_the_text(text):
    began = time.process_time()
    list(pii.block_spans(Texts(pa.array([text]))))
    assert time.process_time() - began < 4


def test_pii_does_not_depend_on_other_words():
    r = random.Random(3)
    bits = ["jane", "x1", "@", " @ ", "[.]", " dot ", "(dot)", "[at]", " at ", ".", ".com", "1O2.16.3.4", "4111 1111 1111 1111", "one two three four", "+44 20 7946 0958", "е", "l"]
    spans = lambda t: [(k, t[a:b], own) for a, k, b, own in next(pii.block_spans(Texts(pa.array([t]))))]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 7)))
        want = spans(t)
        for more in ("\n\nnothing here", "\n\na dot", "\n\n(that is all)", "\n\nsix of us met 7 times in 1999"):
            got = spans(t + more)
            assert got[: len(want)] == want and len(got) == len(want), (t, more)


# ---------------------------------------------------------------- 1


def test_many_windows_in_little_room():
    r = random.Random(1)
    words = [f"w{i:04d}" for i in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(1000)]
    held = WindowSet(8, [str(i) for i in range(1000)], texts)
    assert sum(h.nbytes + f.nbytes + i.nbytes for _, h, f, i in held.sizes) + len(held.text) < 4 * sum(map(len, texts))
    w, hit, found = Scanner(held).scan(Texts(pa.array([f"zz {texts[5][6:66]} zz", "zz " * 50, texts[7]])))
    assert [sorted(x) for x in found] == [[5], [], [7]] and hit[w.first[2] :].all() and not hit[w.first[1] : w.first[2]].any()


def test_items_of_many_rows_and_in_many_parts(spark):
    bench = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "a b c"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b-c y d e f")], "doc_id long, text string")
    for part_bytes in (1, 4, 1 << 20):
        r = find_contamination(docs, bench, part_bytes=part_bytes).first()
        assert r.bench_items == ["1", "2"] and [tuple(x) for x in r.bench_runs] == [(1, 4), (5, 8)] and r.bench_words == 8


# ---------------------------------------------------------------- 2, 6, 10


def test_unknown_events_change_nothing(spark):
    log = [(1, 0, "message", "user", "hi", "m"), (1, 1, "shout", "user", "HI", "m"), (1, 2, None, "user", "x", None), (1, 3, "shout", "user", "y", "n"), (2, 0, None, "user", "z", None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, message_id string")
    assert {r.conv_id: [*chat.parse(r.text)] for r in chat.format_chats(events).collect()} == {1: [("user", "hi")], 2: []}


@pytest.mark.parametrize("n", [5, 100, 420, 5000])
def test_a_report_holds_to_the_end_of_its_clause(n):
    text = "he said " + " ".join(f"word{i}" for i in range(n)) + " you idiot"
    x = toxicity.features(Texts(pa.array([text])), toxicity.Lexicon([], []), toxicity.Grammar(), toxicity.GIVEN)
    assert [m for m, k in zip(toxicity.MATCHES, x[0]) if k] == [("insult", True, "reported")]


def test_equal_texts_have_their_greatest_label(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (4, None)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    rows = toxicity.training_rows(docs, labels, F.lit(False), "doc_id", "text", 100)
    assert sorted(map(tuple, rows.collect())) == [("other", 0), ("same", 1)]


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.template_grams([("x", "two words")], 3)


# ---------------------------------------------------------------- the queries, by the contracts' own words


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_licenses_query(spark, texts):
    names = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = q.op10_licenses(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = ALNUM.findall(texts[r.doc_id].translate(LOW))
        hits = [(i, label) for name, label in names.items() for i in range(len(w)) if w[i : i + len(name.split())] == name.split()]
        base = ",".join(sorted({label for _, label in hits}))
        places = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(places, default=None), max(places, default=None), base)
        assert set(base.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_files()["vocabulary"])
    pieces, room = defaultdict(list), defaultdict(list)
    for r in q.op5_packing(spark, DIR).collect():
        pieces[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    assert padding <= 0.01 * sum(n for x in room.values() for _, n in x)


def test_simhash_query(spark, texts):
    def fingerprint(t: str) -> int:
        w = SOLID.findall(t.translate(LOW))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fp}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = q.op7_simhash(spark, DIR).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{fp[i]:016x}", find(i)) for i in fp} and len(rows) == len(fp)


def test_toxicity_query_finds_toxic_rows(spark):
    """On rows that were not learned from, of a table large enough to learn from."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in q.op6_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in held if labels[r.doc_id]]
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.01, (sum(toxic), len(toxic), sum(clean), len(clean))


def test_main_text_query(spark):
    """The local pages mark their article by an element."""
    from eventloom.llm import html

    rows = {r.page_id: r for r in q.op3_html(spark, DIR).collect()}
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    assert rows.keys() == {p.page_id for p in pages}
    for p in pages:
        article = re.search(r"<article.*?</article>", p.html, re.S)
        want = "\n".join(t for t in html.Page(article.group()).text if t)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def test_digest_of_chats(spark):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    for r in q.op2_chat(spark, DIR).collect():
        turns = sorted(said.pop(r.conv_id))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(t for _, a, t in turns if a == "assistant").encode()).hexdigest() and r.n_turns == len(turns)
    assert not said
