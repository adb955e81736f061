"""Small and odd inputs, exact round trips, and comparisons with brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import boosting, chat, html, licenses, packing, pii, quality, simhash, substrings, toxicity
from eventloom.llm import queries as q
from eventloom.llm.common import Texts
from eventloom.llm.decontaminate import find_contamination, remove_contamination

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["the", "er", "on", "été", "ß", "ing", "x"]


def some_texts(seed: int, n: int, most: int = 120) -> list[str | None]:
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(60)]
    out: list[str | None] = [None, "", " ", "\n\n", "one", "ONE two", "a" * 500]
    while len(out) < n:
        if r.random() < 0.3 and len(out) > 8:
            base = r.choice(out[7:]) or ""
            k = r.randrange(len(base) + 1)
            out.append(base[:k] + r.choice(["", " changed ", "!"]) + base[k + r.randrange(4) :])
        else:
            out.append(r.choice([" ", "  "]).join(r.choice(words) + r.choice(["", ".", ",", "\n"]) for _ in range(r.randint(1, most))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = some_texts(1, 150)
    rows = [(i, t, "en", "s", i) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (20, texts[20], "en", "s", 0), (None, texts[30], "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score long")


# ---------------------------------------------------------------- 1


def brute_contamination(text: str | None, items: dict, n: int = 8):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items.items():
        x = ALNUM.findall(t.translate(LOW))
        size = min(n, len(x))
        for i in range(len(x) - size + 1 if x else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == x[i : i + size]:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs):
    texts = [t for t in some_texts(1, 150) if t]
    items = {i: t for i, t in enumerate([*(" ".join(t.split()[3:15]) for t in texts[10:40:3]), "One", "", "TWO", texts[12]])}
    bench = spark.createDataFrame([*items.items(), (99, None), (None, "the")], "item_id long, text string")
    for part_bytes in (1 << 20, 60):  # in one part, and in many
        got = find_contamination(docs.select("doc_id", "text"), bench, part_bytes=part_bytes).collect()
        assert len(got) == 153
        for r in got:
            assert (r.bench_words, sum(x.end - x.start for x in r.bench_runs), r.bench_items) == brute_contamination(r.text, items)


def test_decontamination_cuts(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, "r s t u v w x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zz A b, c d e F g h! yy", "en", "s", 0), (2, "clean é text", "en", "s", 0), (3, "a b c d e f g h / r s t u v w x y", "en", "s", 0), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, score long")
    got = {r.doc_id: r.text for r in remove_contamination(docs, bench).collect()}
    assert got == {1: "zz ! yy", 2: "clean é text", 4: None}
    assert remove_contamination(empty, bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).where("size(bench_items) > 0").count() == 0


# ---------------------------------------------------------------- 2


def test_chat_round_trip():
    r = random.Random(4)
    bits = [*chat.CONTROL, "\\", "<", "[", "/", " ", "a", "\n", "s>", "INST]", "<<", ">>", "é"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", ""]), "".join(r.choice(bits) for _ in range(r.randrange(8)))) for _ in range(r.randrange(5))]
        text, mask = chat.render(turns)
        assert list(chat.parse(text)) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for role, t in turns if role == "assistant"]


def test_chat_fold(spark):
    log = [
        (1, 0, "message", "user", "hi", "m0"), (1, 1, "delta", "assistant", "he", "m1"), (1, 2, "delta", "assistant", "llo", "m1"),
        (1, 3, "edit", "user", "hey", "m0"), (1, 4, "message", "user", "more", "m2"), (1, 5, "regenerate", "assistant", "", "m1"), (1, 6, "delta", "assistant", "bye", "m1"),
        (1, 7, "message", "user", "gone", "m3"), (1, 8, "delete", None, None, "m3"), (2, None, "message", None, None, None), (2, 0, "message", "assistant", "x", None), (None, 0, "message", "user", "n", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, message_id string")
    got = {r.conv_id: [*chat.parse(r.text)] for r in chat.format_chats(events).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "bye")], 2: [("", ""), ("assistant", "x")], None: [("user", "n")]}
    assert chat.read_back(chat.format_chats(events.limit(0))).count() == 0


def test_chat_pieces(spark):
    """A long conversation is read back from several parts as from one."""
    log = [(1, i, "message", ["user", "assistant"][i % 2], f"turn {i} </s>", None) for i in range(40)] + [(2, 0, "message", "user", "x", None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, message_id string")
    many = chat.format_chats(events, piece=50)
    assert many.where("conv_id = 1").count() > 5
    assert sorted(map(tuple, chat.read_back(many).collect())) == sorted(map(tuple, chat.read_back(chat.format_chats(events)).collect()))


# ---------------------------------------------------------------- 3


@pytest.fixture(scope="module")
def trees():
    return html.model()


def test_main_text_of_made_pages(trees):
    maker = html.Maker(1234)
    exact = kept = lost = extra = 0
    for _ in range(150):
        page = maker.page()
        want = [t.replace(html._IN, "").replace(html._OUT, "") for t in html.Page(page).text if t and html._IN in t]
        got = html.extract([page.replace(html._IN, "").replace(html._OUT, "")], trees)[0].split("\n")
        exact += got == (want or [""])
        kept += len(set(want) & set(got))
        lost += len(set(want) - set(got))
        extra += len(set(got) - set(want) - {""})
    assert exact >= 120 and lost <= 0.03 * kept and extra <= 0.03 * kept


def test_pages_that_are_odd(spark, trees):
    pages = ["", "no markup at all", "<p", "<p>a<p>b", "</div></p>text", "<script>if (a<b) '</p>'</script><article><h1>T</h1><p>x &amp; y&nbsp;z &lt;b&gt; &#233; <b>in</b>line<br>end</p></article>", "<div>" * 3000 + "deep", "a < b and <b>c</b> > d", "<!-- x --><![CDATA[y]]>"]
    got = html.extract(pages, trees)
    assert len(got) == len(pages) and got[0] == ""
    assert got[5] == "T\nx & y z <b> é inline end"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, pages[5])], "page_id long, html string")
    assert [r.text for r in html.main_text(rows).orderBy("page_id").collect()] == ["", "", got[5]]


def test_decoding_is_hierarchical(trees):
    """What stays is closed upwards, and no other such tree is likelier."""
    page = html.Page("<body><div><p>a</p><p>b</p></div><section><p>c</p></section>d</body>")
    n = len(page.parent)
    r = np.random.default_rng(1)
    for _ in range(30):
        odds = r.normal(0, 2, n)
        best, most = None, -np.inf
        for bits in range(1 << n):
            keep = [bool(bits >> i & 1) for i in range(n)]
            if keep[0] and all(keep[page.parent[i]] for i in range(1, n) if keep[i]):
                v = sum(-np.logaddexp(0, -o) if k else -np.logaddexp(0, o) for o, k in zip(odds, keep))
                if v > most:
                    best, most = keep, v
        assert html.decode(page, odds) == [t for t, k in zip(page.text, best) if t and k]


def test_boosting_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit(x[:1500], y[:1500], n_trees=40, depth=3, share=1.0)
    assert ((t.predict(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93


# ---------------------------------------------------------------- 4


def brute_quality(t: str | None):
    t = t or ""
    w = SOLID.findall(t)

    def cover(size):
        n = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        return len({j for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})

    seen, dup = set(), 0
    for line in t.split("\n"):
        if SOLID.search(line):
            dup += line in seen
            seen.add(line)
    longest = next((k for k in range(len(w), 0, -1) if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1), 0)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, cover(3), cover(10), longest


def test_quality_against_brute_force():
    texts = [*some_texts(7, 80, 60), "a b c d e f g h i j k " * 6, "x\n\nx\n x\nx", "# & <b> |\n# & <b> |", "a " * 300]
    got = quality.measure(Texts(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert tuple(got[c][i].as_py() for c in quality.COUNTS) == brute_quality(t), t


def test_quality_verdicts(spark, empty):
    r = random.Random(3)
    good = " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(400))
    line = " ".join(good.split()[:25])
    rows = [(1, good), (2, None), (3, "short"), (4, line + "\n" + good + "\n" + "\n".join([line] * 10)), (5, good + " " + good)]
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert quality.score_quality(empty).count() == 0


# ---------------------------------------------------------------- 5


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    files = q.tokenizer_files()
    whole = Tokenizer.from_file(files["vocabulary"])
    more = docs.unionByName(spark.createDataFrame([(900, "<|endoftext|> Привет мир", "x", "s", 0), (901, "word " * 9000, "x", "s", 0)], docs.schema))
    rows = packing.pack(more.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), **files, group_tokens=3000).collect()
    texts = {r.doc_id: r.text for r in more.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, mine in pieces.items():
        ids = whole.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert [i for r in sorted(mine, key=lambda r: r.start) for i in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    assert packing.pack(empty, **files).count() == 0


def test_tokenizers_agree():
    files = q.tokenizer_files()
    fast, slow = packing.encoder(**files), packing.encoder(files["vocabulary"], None, None)
    r = random.Random(5)
    texts = ["".join(chr(r.choice([r.randrange(0x280), r.randrange(0x80), 32, 10, 39, 0x85, 0xA0, r.randrange(48, 58)])) for _ in range(r.randrange(60))) for _ in range(1500)]
    x = Texts(pa.array(texts))
    assert all(a.tolist() == b.tolist() for a, b in zip(fast(x), slow(x)))


def test_balance_takes_the_cheapest_with_room():
    placed, over = packing.balance(np.array([6, 5, 5, 4]), 10)
    assert {(s, p) for s, p, _, _ in placed} == {(0, 0), (1, 1), (1, 2), (0, 3)} and not over


# ---------------------------------------------------------------- 6


def test_grammar():
    g = toxicity.Grammar()
    assert g.matches([None, "insult"]) == [("insult", False, "asserted")]
    assert g.matches(["target", None, "insult"]) == [("insult", True, "asserted")]
    assert g.matches(["negation", "insult"]) == [("insult", False, "negated")]
    assert g.matches(["report", None, None, None, "insult", "target"]) == [("insult", True, "reported")]
    assert g.matches(["modal", "threat", "target"]) == [("threat", True, "asserted")]
    assert g.matches([None, "target", "report"]) == []


def test_toxicity_learns_stems(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefg") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [r.choice(words) for _ in range(40)]
        if i % 6 == 0:
            for _ in range(3):
                text.insert(r.randrange(40), r.choice(["zorkle", "zorkish", "zorkan"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "You are a stupid idiot."), (1003, "x " * 30000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, toxicity.train(docs, lab)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert got[1000] == got[1001] < 0.5 < got[1002] and got[1003] < 0.5
    none = toxicity.train(docs, lab.limit(0))
    assert none.stems == [] and np.array_equal(none.weights, toxicity.GIVEN)


# ---------------------------------------------------------------- 7


def brute_fingerprint(t: str | None) -> int:
    w = SOLID.findall((t or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    c = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(shingles))


def test_trie_join_and_links(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    near = [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6)]
    fps = sorted({*base, *near, 0, 1, 3, 7, (1 << 64) - 1})
    a, b = simhash.trie_join(np.array(fps, np.uint64), np.zeros(len(fps), int), 2)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    root = {x.node: x.root for x in simhash.components(simhash.links(df, "fp", 2)).collect()}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in want:
        up[max(find(i), find(j))] = min(find(i), find(j))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    mine = defaultdict(set)
    for i, f in enumerate(signed):
        mine[root.get(f, f)].add(find(i))
    assert all(len(x) == 1 for x in mine.values()) and len(mine) == len({find(i) for i in range(len(fps))})


def test_near_duplicates(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 153
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in rows)
    comp = {}
    ids = sorted(texts, key=lambda d: (d is None, d or 0))
    group = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                if (fps[x] ^ fps[y]).bit_count() <= 2:
                    least = min((group[x], group[y]), key=lambda d: (d is None, d or 0))
                    if group[x] != least or group[y] != least:
                        group[x] = group[y] = least
                        changed = True
    comp = group
    assert all(r.component_id == comp[r.doc_id] for r in rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted({comp[d] for d in ids}, key=str) and "score" in simhash.keep_one(docs).columns


# ---------------------------------------------------------------- 8

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t: str):
    dg = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(dg(m.group())) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(dg(m.group())[::-1])) % 10 == 0]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(dg(m.group())) <= 15]
    return sorted(out)


def test_pii_base():
    r = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", "+", "1", "23", "4111111111111111", "255", "256", " ", "(", ")", "é", "x@y.z", "+1 (499) 555-6503", "10.0.0.1", "\n", "_%"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(6000)]
    for t, got in zip(texts, pii.block_spans(Texts(pa.array(texts)))):
        assert [s[:3] for s in got if s[3]] == brute_pii(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("mary dot smith at mail dot example dot org", "email", "mary dot smith at mail dot example dot org"),
        ("plus four nine one seven two three four five six seven", "phone", "plus four nine one seven two three four five six seven"),
        ("x ４１１１ １１１１ １１１１ １１１１ y", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("joһn@ехаmple.com", "email", "joһn@ехаmple.com"),
        ("ja​ne@x.org", "email", "ja​ne@x.org"),
        ("4111 l111 1111 1111", "card", "4111 l111 1111 1111"),
    ],
)
def test_pii_disguised(text, kind, found):
    spans = [(pii.KINDS[k], text[a:b]) for a, k, b, own in next(pii.block_spans(Texts(pa.array([text])))) if not own]
    assert spans == [(kind, found)]


@pytest.mark.parametrize("text", ["we met at noon", "look at me. dot com", "one two three", "der Ort, an dem es steht: ёлка", "he is at the dot"])
def test_pii_leaves_prose(text):
    assert next(pii.block_spans(Texts(pa.array([text])))) == []


def test_redact(spark, empty):
    rows = spark.createDataFrame([(1, "a@b.cd and 10.0.0.1, é", "x"), (2, None, "x"), (3, "clean", "x")], "doc_id long, text string, pii string")
    assert {r.doc_id: r.text for r in pii.redact(rows).collect()} == {1: "[EMAIL] and [IP], é", 2: None, 3: "clean"}
    assert pii.redact(empty).count() == 0


# ---------------------------------------------------------------- 9


def brute_repeats(rows: list[tuple[int, str | None]], length: int):
    """Removed bytes of each row; rows of one id do not remove from each other."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        out.append((i, t, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("limits", [(32, 512), (1, 2)])  # few hot grams, and nearly all of them
def test_repeated_substrings(spark, docs, empty, limits, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_CONTEXTS", limits[0])
    monkeypatch.setattr(substrings, "ALL_CONTEXTS", limits[1])
    passage = " ".join(some_texts(9, 20)[15].split()[:30])
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    rows += [(500 + i, f"{i} start {passage[i % 7 :]} and an end {i * 7}") for i in range(40)] + [(600, "ab" * 400), (601, "ab" * 300), (602, "a" * 49)]
    df = spark.createDataFrame([*rows, (None, passage)], "doc_id long, text string").repartition(6)
    for length in (50, 30):
        got = Counter((r.doc_id, r.text, bytes(r.kept)) for r in substrings.remove_repeats(df, length=length).collect())
        assert got == Counter([*brute_repeats(rows, length), (None, passage, passage.encode())])
    assert substrings.remove_repeats(empty).count() == 0


def test_deep_shallow_orders_suffixes():
    r = random.Random(3)
    buf = "".join(r.choice("ab") for _ in range(300)) + "abab" * 60 + "".join(r.choice("abc") for _ in range(200))
    raw = np.frombuffer(buf.encode(), np.uint8)
    start = np.arange(len(buf) - 50 + 1)
    rank = substrings.deep_shallow(raw, start, 50)
    words = [buf[i : i + 50] for i in start]
    order = sorted(range(len(words)), key=lambda i: words[i])
    assert [words[i] for i in np.argsort(rank, kind="stable")] == [words[i] for i in order]
    assert all((rank[i] == rank[j]) == (words[i] == words[j]) for i in range(0, 400, 7) for j in range(0, len(words), 5))


# ---------------------------------------------------------------- 10


def test_licenses(spark, docs, empty):
    full = dict((label, t) for label, t in licenses.TEMPLATES if len(t) > 200)
    cut = full["mit"].split()
    changed = " ".join(cut[:30] + ["very", "new"] + cut[32:])
    rows = [(1, None), (2, ""), (3, "mit license, The MIT License"), (4, f"before words {changed} after"), (5, "Licensed under CC BY-NC 4.0."), (6, "general public license"), (7, full["apache"]), (8, "permission is hereby granted to nobody"), (8, "mit licensed")]
    got = [(r.doc_id, r.n_words, [(s.label, s.start, s.base) for s in r.licenses]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "n_words").collect()]
    assert got[:3] == [(1, 0, []), (2, 0, []), (3, 5, [("mit", 0, True), ("mit", 3, True)])]
    assert [x[:2] for x in got[3][2]] == [("mit", 2)] and [x[0] for x in got[4][2]] == ["cc-by-nc"] and got[5][2] == [("gpl", 0, True)]
    assert {x[0] for x in got[6][2]} == {"apache"} and got[7][2] == [] and got[8][2] == []
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == 153


# ---------------------------------------------------------------- columns that are there already


def test_columns_with_the_same_names(spark):
    """Columns that a table has already stay as they are; the new ones come last, with lengthened names."""
    rows = spark.createDataFrame([(1, "a@b.cd", 5, "x", 7, 8, 9)], "doc_id long, text string, PII int, removed string, bench_words int, score int, KEPT int")
    found = pii.find_pii(rows).first()
    assert (found["PII"], found["pii_"][0].kind) == (5, "email")
    cut = substrings.remove_repeats(rows).first()
    assert (bytes(cut["kept_"]), cut["removed"], cut["KEPT"]) == (b"a@b.cd", "x", 9)
    assert find_contamination(rows, spark.createDataFrame([(1, "b cd")], "item_id long, text string")).first()["bench_items"] == ["1"]
    scored = toxicity.score_toxicity(rows, toxicity.Model([], [], toxicity.GIVEN)).first()
    assert scored["score"] == 8 and scored["score_"] < 0.5
    good = quality.score_quality(rows).first()
    assert (good["KEPT"], good["kept_"], good["base_failed"]) == (9, False, True)
    assert licenses.scan_licenses(rows).columns == ["doc_id", "n_words", "licenses"]
    assert simhash.keep_one(rows).columns == rows.columns
    events = spark.createDataFrame([(1, 0, "message", "user", "hi", None, 3)], "conv_id long, seq long, kind string, role string, text string, message_id string, part int")
    assert chat.format_chats(events).columns == ["conv_id", "part", "text", "mask"]


# ---------------------------------------------------------------- queries and the pipeline


def test_digests_of_the_queries(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in q.op8_pii(spark, d).collect():
        base = brute_pii(texts[r.doc_id] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_email == sum(k == 0 for _, k, _ in base)
    want = {i: kept for i, _, kept in brute_repeats(sorted(texts.items()), 50)}
    for r in q.op9_substrings(spark, d).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest() and r.n_bytes - r.n_removed == len(want[r.doc_id])
    assert {c for c, _ in q.op10_licenses(spark, d).dtypes} >= {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    held = q.op6_toxicity(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in held)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars", "score", "rank"))
    seen = {}
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    before, after = seen["near_duplicates"]
    rows = sorted({(r.doc_id, r.text or "") for r in before.collect() if r.doc_id is not None})
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    alike = lambda i, j: len(grams[i] & grams[j]) / max(1, len(grams[i] | grams[j]))
    stay = {r.doc_id for r in after.collect()} - {None}
    # What goes is like something with a smaller id or linked through others; of what stays no two are near copies.
    assert all(any(alike(i, j) >= 0.6 for j in grams if j != i) for i in set(grams) - stay)
    assert not [(i, j) for i in stay for j in stay if i < j and alike(i, j) >= 0.9]
    assert {min(j for j in grams if grams[j] == grams[i]) for i in grams} >= stay
    _, after = seen["pii"]
    assert not [r for r in after.collect() if brute_pii(r.text or "")]
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert all(brute_contamination(r.text, bench)[1] == 0 for r in seen["decontamination"][1].collect())
    assert {r.doc_id for r in seen["packing"][1].select("doc_id").collect()} == {r.doc_id for r in after.collect()}
    assert p.run(spark, d).count() > 0
