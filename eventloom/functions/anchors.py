"""Typed facts in text, in order of priority; a later kind never claims what an earlier one has."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("url", re.compile(r"https?://[^\s<>\"']+[^\s<>\"'.,;:!?)\]]")),
    ("phone", re.compile(r"\+\d[\d ().-]{7,}\d")),
    ("date", re.compile(rf"(?i)\b(?:(?P<y>\d{{4}})-(?P<m>\d\d?)-(?P<d>\d\d?)|(?P<mn>{_MONTH})\.? (?P<md>\d\d?)(?:st|nd|rd|th)?(?:,? (?P<my>\d{{4}}))?|(?P<dd>\d\d?) (?P<dm>{_MONTH})(?: (?P<dy>\d{{4}}))?)\b")),
    ("time", re.compile(r"(?i)\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?: ?[ap]m)?\b|\b(?:1[0-2]|[1-9]) ?[ap]m\b")),
    ("money", re.compile(rf"(?i)[$€£] ?(?:{_NUMBER})(?: ?(?:thousand|million|billion|mn|bn|[kmb])\b)?|\b(?:{_NUMBER}) ?(?:dollars|euros|usd|eur)\b")),
    ("percent", re.compile(rf"(?i)(?:{_NUMBER}) ?(?:%|percent\b)")),
    ("number", re.compile(rf"(?<![\w.])(?:{_NUMBER})(?![\w]|\.\d)")),
]


def canon_number(s: str) -> str:
    v = float(s.replace(",", ""))
    return str(int(v)) if v == int(v) else repr(v)


def canonical(kind: str, m: re.Match) -> str:
    s = m.group()
    if kind in ("email", "url"):
        return s.lower()
    if kind == "phone":
        return re.sub(r"[^\d+]", "", s)
    if kind == "date":
        month = m["mn"] or m["dm"]
        k = int(m["m"]) if m["m"] else next(i + 1 for i, x in enumerate(MONTHS) if x.startswith(month.lower()[:3]))
        return f"{m['y'] or m['my'] or m['dy'] or '----'}-{k:02d}-{int(m['d'] or m['md'] or m['dd']):02d}"
    if kind == "time":
        h, _, rest = re.sub(r"(?i) ?[ap]m", "", s).partition(":")
        half = re.search(r"(?i)([ap])m", s)
        hour = int(h) % 12 + 12 * (half[1].lower() == "p") if half else int(h)
        return f"{hour:02d}:{rest[:2] or '00'}"
    number = re.search(_NUMBER, s)
    value = float(number.group().replace(",", ""))
    if kind == "money":
        scale = re.search(r"(?i)(thousand|million|billion|mn|bn|[kmb])\b", s[number.end() :])
        value *= _SCALE.get(scale[1].lower(), 1) if scale else 1
        sign = next((c for c in "$€£" if c in s), "€" if re.search("(?i)eur", s) else "$")
        return sign + canon_number(repr(value))
    return canon_number(repr(value)) + ("%" if kind == "percent" else "")


def anchors(text: str | None, names: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), by place. names: of actors, in small letters, with what each stands for; the longest is found."""
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    kinds = list(KINDS)
    if names:
        one = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
        kinds.insert(2, ("actor", re.compile(rf"(?i)(?<!\w)(?:{one})(?!\w)")))
    for kind, pattern in kinds:
        for m in pattern.finditer(text or ""):
            a, b = m.span()
            if not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                out.append((a, b, kind, names[m.group().lower()] if kind == "actor" else canonical(kind, m)))
    return sorted(out)


_PLAIN = frozenset("the a an of in on at to by for and or is was are were be it its this that with from as".split())


def context_key(text: str, start: int, end: int) -> str | None:
    """The word that says what a fact is about: the nearest before it in its sentence that is not a plain one, else after it.

    It stands for the syntactic head, which a parser would give; there is no model for that here.
    """
    before = re.split(r"[.!?\n](?:\s|$)", text[:start])[-1]
    after = re.split(r"[.!?\n](?:\s|$)", text[end:])[0]
    words = lambda s: [w for w in re.findall(r"[^\W\d_]{2,}", s.lower()) if w not in _PLAIN]
    left, right = words(before), words(after)
    return left[-1] if left else right[0] if right else None


_TYPE = "array<struct<start:int,end:int,kind:string,value:string>>"


def _anchors(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in anchors(t)] for t in texts])


def with_anchors(df: DataFrame, text: str, name: str = "anchors") -> DataFrame:
    """df with the facts of each text. Texts without a digit or an @ do not go to Python."""
    return df.withColumn(name, F.when(F.col(text).rlike("[0-9@]|https?:"), F.pandas_udf(_anchors, _TYPE)(F.col(text))).otherwise(F.array().cast(_TYPE)))
