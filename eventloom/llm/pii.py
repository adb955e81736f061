"""Personal data: patterns on the text as it stands, and again on what transducers make of disguised text.

A tape holds a text and, for each of its characters, the part of the source it came from. Transducers rewrite
tapes one after another: characters that look like Latin ones or digits, and characters without width; digits in
words; "at" and "dot" in brackets or words. Identifiers found on the last tape are mapped back to source
characters. They are added where no span of the same kind found on the text itself holds them.

Spans count code points, end exclusive. Null and empty texts have none. A text's spans depend on that text alone.
Every pattern starts only where nothing before it could have started it, and disguised addresses are read outwards
from their "at", so the time is in proportion to a text's length, however long it is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.common import Texts, blocks, map_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
#: As they are after the @; what stands before it is found from there.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: From the first digit of a row: what fails there fails at the row's other digits too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def identifiers(t: str, digits: int | None = None) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of what the patterns find; digits: how many there are, if known."""
    found = []
    if "@" in t:
        last = 0
        for m in _DOMAIN.finditer(t):
            a = m.start()
            while a > last and t[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                found.append((a, 0, last := m.end()))
    digits = len(_digits(t)) if digits is None else digits
    if digits >= 4:
        # A part of a thousand digits or more is over 255 too, and int() need not read it.
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split("."))]
    if digits >= 12:
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(t) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if digits >= 9 and "+" in t:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 9 <= len(_digits(m.group())) <= 15]
    return found


class Tape:
    """A text, and of each character where its source begins and ends."""

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.begin = list(range(len(text))) if begin is None else begin
        self.end = list(range(1, len(text) + 1)) if end is None else end


class Transducer:
    """Reads the longest inputs that it accepts, writes output for them, and copies what lies between."""

    def __init__(self, accepts: str | Callable[[str], Iterator[tuple[int, int, str]]], writes: Callable[[re.Match], str | None] | None = None):
        """accepts: a pattern, with what it writes for a match (or None); or what gives (start, end, output) from left to right."""
        self.accepts, self.writes = re.compile(accepts) if isinstance(accepts, str) else accepts, writes

    def read(self, text: str) -> Iterator[tuple[int, int, str]]:
        if not self.writes:
            yield from self.accepts(text)
            return
        for m in self.accepts.finditer(text):
            new = self.writes(m)
            if new is not None:
                yield *m.span(), new

    def __call__(self, tape: Tape) -> Tape:
        out: list[str] = []
        begin: list[int] = []
        end: list[int] = []
        last = 0
        for a, b, new in self.read(tape.text):
            out += [tape.text[last:a], new]
            begin += tape.begin[last:a] + [tape.begin[a]] * len(new)
            end += tape.end[last:a] + [tape.end[b - 1]] * len(new)
            last = b
        if not last:
            return tape
        out.append(tape.text[last:])
        return Tape("".join(out), begin + tape.begin[last:], end + tape.end[last:])


# Letters of other scripts that look like Latin letters.
_LOOKALIKES = dict(zip("авеікмнорстухѕјԁһԛԝАВЕІКМНОРСТУХЅЈαοιρνκτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeikmhopctyxsjdhqwABEIKMHOPCTYXSJaoipvktuxABEZHIKMNOPTYX"))
_NO_WIDTH = "­​‌‍‎‏⁠﻿"


def _plain(m: re.Match) -> str | None:
    out = []
    for c in m.group():
        if c in _NO_WIDTH:
            continue
        c = _LOOKALIKES.get(c, c)
        if "‐" <= c <= "―" or c == "−":
            c = "-"
        elif c > "ɏ":
            n = unicodedata.normalize("NFKC", c)
            c = n if n.isascii() else str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else c
        out.append(c)
    new = "".join(out)
    return None if new == m.group() else new


_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ANY = "|".join(_WORDS)
#: Digits in words in a row; a plus before them, and separators between them.
_SPOKEN = rf"(?i)(?<![^\W_])(?:plus[ -]+)?(?:{_ANY})(?:(?:[ .,-]{{1,2}})(?:{_ANY})){{3,}}(?![^\W_])"


def _spoken(m: re.Match) -> str:
    return "".join("+" if w == "plus" else _WORDS[w] for w in re.findall(rf"plus|{_ANY}", m.group().lower()))


_CORE = re.compile(r"(?i)[\[({<] *at *[\])}>]|at|@")
_TOKEN = r"[A-Za-z0-9_%+-]++"
_DOT = r"(?: *[\[({<] *(?:dot|\.) *[\])}>] *| +dot +|\.)"
#: What comes before an "at", read from its end; and what comes after.
_BEFORE = re.compile(rf"(?i){_TOKEN}(?:(?: *[\])}}>] *(?:tod|\.) *[\[({{<] *| +tod +|\.){_TOKEN})*+")
_AFTER = re.compile(rf"(?i){_TOKEN}(?:{_DOT}{_TOKEN})++")
_DOTS = re.compile(rf"(?i){_DOT}")
_DISGUISED_DOT = re.compile(r"(?i) dot |[\[({<] *dot")


def addresses(t: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, as it is meant) of the addresses with disguised or plain "at" and dots, from left to right."""
    done = 0
    for m in _CORE.finditer(t):
        a, b = m.span()
        if a < done:
            continue
        word = m.group() not in "@" and m.group()[0] not in "[({<"
        while a > done and t[a - 1] == " ":
            a -= 1
        while b < len(t) and t[b] == " ":
            b += 1
        if word and (a == m.start() or b == m.end()):
            continue  # "at" is a word of its own only between spaces
        after = _AFTER.match(t, b)
        if not after:
            continue
        before = _BEFORE.match(t[done:a][::-1])
        if not before:
            continue
        start, end = a - before.end(), after.end()
        done = end
        left, right = t[start:a], after.group()
        # A worded "at" alone is prose: the dots must be in disguise as well.
        if word and not _DISGUISED_DOT.search(left + " @ " + right):
            continue
        yield start, end, _DOTS.sub(".", left) + "@" + _DOTS.sub(".", right)


#: A lone letter that looks like a digit, between digits.
_INNER = r"(?<=[0-9][ -])[OoIl](?=[0-9])|(?<=[0-9])[OoIl](?=[ -]?[0-9])"

HOMOGLYPHS = Transducer(rf"[{_NO_WIDTH}Ͱ-\U0010ffff]+", _plain)
DIGIT_LETTERS = Transducer(_INNER, lambda m: "0" if m.group() in "Oo" else "1")
SPOKEN_DIGITS = Transducer(_SPOKEN, _spoken)
AT_AND_DOT = Transducer(addresses)
CHAIN = (HOMOGLYPHS, SPOKEN_DIGITS, DIGIT_LETTERS, AT_AND_DOT)
_LETTER_IN_NUMBER = re.compile(_INNER)
#: "one" and "oh" are in many words: only two in a row count.
_SPELLED = (b"zero", b"two", b"three", b"four", b"five", b"six", b"seven", b"eight", b"nine")
_ONES = re.compile(rb"(?:one|oh)[ .,-]{1,2}(?:one|oh)")
#: What case-blind patterns take for i and s.
_ODD_CASE = ("İ".encode(), "ı".encode(), "ſ".encode())


def may_rewrite(raw: bytes, digits: int, far: int) -> bool:
    """Whether a transducer may accept something in a text; false only if none does, or identifiers stay as they are."""
    low = raw.lower()
    if far or b"dot" in low or any(w in low for w in _SPELLED) or any(w in raw for w in _ODD_CASE) or _ONES.search(low):
        return True
    brackets = b"[" in low or b"(" in low or b"{" in low or b"<" in low
    if brackets and (b"@" in low or b"at" in low) or b" @" in low or b"@ " in low:
        return True
    # Each part of a number has a digit of its own, so four are the least: an IP's.
    return digits >= 4 and _LETTER_IN_NUMBER.search(raw.decode()) is not None


def rewritten(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """What is found only on the last tape, in places of t."""
    tape = Tape(t)
    for step in CHAIN:
        tape = step(tape)
    out = []
    if tape.text != t:
        # Spans of one kind never overlap, so only the last that begins no later can hold a place.
        held = [sorted((x, y) for x, k, y in base if k == kind) for kind in range(len(KINDS))]
        for a, kind, b in identifiers(tape.text):
            a, b = tape.begin[a], tape.end[b - 1]
            i = bisect_right(held[kind], (a, len(t) + 1)) - 1
            if i < 0 or held[kind][i][1] < b:
                out.append((a, kind, b, False))
    return out


def spans(raw: bytes, digits: int, far: int) -> list[tuple[int, int, int, bool]]:
    """(start, place of the kind, end, found on the text itself) by start, then kind.

    far: how many bytes of characters there are that transducers may rewrite by themselves.
    """
    more = may_rewrite(raw, digits, far)
    if not (more or digits >= 4 or b"@" in raw):
        return []
    t = raw.decode()
    base = identifiers(t, digits)
    out = [(*x, True) for x in base]
    if more:
        out += rewritten(t, base)
    out.sort()
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _sums(inside: np.ndarray, off: np.ndarray) -> list[int]:
    return np.diff(np.concatenate(([0], np.cumsum(inside)))[off]).tolist()


def block_spans(texts: Texts) -> Iterator[list[tuple[int, int, int, bool]]]:
    buf = texts.buf
    digits = _sums((buf >= 0x30) & (buf <= 0x39), texts.off)
    soft = np.zeros(len(buf), bool)
    soft[1:] = (buf[1:] == 0xAD) & (buf[:-1] == 0xC2)
    far = _sums((buf >= 0xCD) | soft, texts.off)
    for i in range(texts.n):
        yield spans(texts.bytes(i), digits[i], far[i])


def find_pii(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """docs with the spans of each text, by start, then kind; base is false for those that transducers made visible."""

    def each():
        def of(texts: Texts) -> dict[str, pa.Array]:
            return {name: pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in x] for x in block_spans(texts)], _SPANS)}

        return of

    return with_columns(docs, text, T.StructType([T.StructField(name, T.ArrayType(SPAN))]), each)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all personal data in text replaced by the kind in brackets; overlapping spans become one, of the first's kind."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, text):
            columns = list(part.columns)
            found = list(block_spans(texts))
            if any(found):
                values = columns[at].to_pylist()
                for i, mine in enumerate(found):
                    if mine:
                        pieces, last, t = [], 0, values[i]
                        for a, kind, b, _ in mine:
                            if a >= last:
                                pieces += [t[last:a], f"[{KINDS[kind].upper()}]"]
                            last = max(last, b)
                        values[i] = "".join([*pieces, t[last:]])
                columns[at] = pa.array(values, part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, docs.schema)

