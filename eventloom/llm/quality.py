"""Quality rules: counts of a text's words, symbols and repeated lines, and repetition by a suffix array.

The suffix array of each text is built over numbers of its words (equal for equal bytes, and for no others: hashes
are compared byte for byte) by prefix doubling, many texts at once; groups that are already apart are not sorted
again. Common prefixes of neighbours come from the ranks of each doubling. A stack over these prefixes finds the
intervals of the suffix array that share a prefix of min_repeat words or more; an interval whose places are not all
preceded by one word is a maximal repeated substring. Its spans are those of the places that no deeper interval
holds, which lie inside that one's. The spans of all are united, and two limits are put on them: the fraction of
words that they cover, and the length of the longest.

Null and empty texts have no words, and fail the base rule. A text's figures depend on that text alone; very long
texts are measured whole. Columns of docs that have the names of the new ones stay, and the new names are lengthened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import SOLID, Rolling, Texts, Words, _table, free_name, span_ids, with_columns

SYMBOLS = _table(b"#*$%&|<>")
MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100


def suffix_ranks(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of the texts in ids, and for each k the ranks by the first 2**k words.

    ids are numbers of words below 2**32. Texts never share a rank. Each array of ranks has one more place, for the end.
    """
    n = len(ids)
    key = (doc << 32) | ids
    order = np.argsort(key)
    s = key[order]
    heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    sizes = np.diff(np.append(heads, n))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels = [rank]
    active = order[np.repeat(sizes > 1, sizes)]
    last = np.zeros(n + 1, np.int64)
    if n:
        last[:n] = np.repeat(np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n), np.diff(np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [n]))))
    size = 1
    while len(active):
        then = active + size
        then = np.where(then < last[active], rank[np.minimum(then, n)] + 1, 0)
        first = rank[active]
        pair = (first << 32) | then
        o = np.argsort(pair)
        active, pair, first = active[o], pair[o], first[o]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(pair)))
        # The group's first place, plus how many of it come before.
        group = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        begin = np.repeat(group, np.diff(np.append(group, len(first))))
        rank = rank.copy()
        rank[active] = np.repeat(first[heads] + heads - begin[heads], sizes)
        levels.append(rank)
        active = active[np.repeat(sizes > 1, sizes)]
        size *= 2
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa, levels


def common_prefixes(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and of each of its places the words in common with the one before."""
    n = len(ids)
    sa, levels = suffix_ranks(ids, doc)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) if n else np.zeros(0, np.int64)
    a, b = sa[at].copy(), sa[at + 1].copy() if len(at) else sa[at].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a += step
        b += step
        lcp[at + 1] += step
    return sa, lcp


def maximal_repeats(ids: np.ndarray, doc: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the spans of maximal repeats of at least so many words: of each start those of its deepest interval."""
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return deep, deep
    # The word before each place; a text's first place has one of its own.
    before = np.where((sa > 0) & (doc[sa - 1] == doc[sa]), ids[sa - 1], -1 - sa)
    turns = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    places: list[int] = []
    sizes: list[int] = []
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for run in np.split(deep, cuts):
        common = [*lcp[run].tolist(), 0]
        # Open intervals: words in common, first place, and the places for which they are the deepest.
        stack: list[tuple[int, int, list[int]]] = []
        was = 0
        for k, i in enumerate(range(int(run[0]), int(run[-1]) + 2)):
            x, first = common[k], i - 1
            while stack and stack[-1][0] > x:
                size, first, own = stack.pop()
                if turns[i - 1] > turns[first]:
                    places += own
                    sizes += [size] * len(own)
            if x:
                if not stack or stack[-1][0] < x:
                    stack.append((x, first, []))
                if x > was:
                    stack[-1][2].append(i - 1)
                if x >= common[k + 1]:
                    stack[-1][2].append(i)
            was = x
    return sa[np.array(places, np.int64)], np.array(sizes, np.int64)


def covered(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _sums(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    return np.diff(c[at])


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
FIELDS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("repeat_spans", T.ArrayType(SPAN))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def measure(texts: Texts, min_repeat: int = MIN_REPEAT) -> dict[str, pa.Array]:
    """The figures of a block of texts; repeat_spans are runs of word numbers, end exclusive."""
    w = Words(texts, SOLID)
    buf, off, n = texts.buf, texts.off, len(w.start)
    roll = Rolling(buf)
    ids = span_ids(buf, w.start, w.end, roll.spans(w.start, w.end))
    sa, lcp = common_prefixes(ids, w.doc)
    longest = np.zeros(n, np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp
    # Lines with a word, and those of them that are not the first of their kind.
    cut = np.flatnonzero(buf == 10)
    a = np.sort(np.concatenate((off[:-1], cut + 1)), kind="stable")
    in_doc = np.searchsorted(off, a, "right") - 1 if len(a) else a
    # A line that starts where its text ends belongs to that text, and is empty.
    b = np.minimum(np.append(a[1:], off[-1]), off[np.minimum(in_doc + 1, texts.n)])
    b = np.where((b > a) & (b > 0) & (np.append(buf, 0)[np.maximum(b - 1, 0)] == 10), b - 1, b)
    has = np.searchsorted(w.start, b) > np.searchsorted(w.start, a)
    a, b, in_doc = a[has], b[has], in_doc[has]
    key = (in_doc << 32) | span_ids(buf, a, b, roll.spans(a, b))
    _, firsts = np.unique(key, return_index=True)
    dup = np.bincount(in_doc, minlength=texts.n) - np.bincount(in_doc[firsts], minlength=texts.n)
    inside = covered(n, *maximal_repeats(ids, w.doc, sa, lcp, min_repeat))
    most = np.zeros(texts.n, np.int64)
    np.maximum.at(most, w.doc, longest)
    spans: list[list] = [[] for _ in range(texts.n)]
    counts = _sums(inside, w.first)
    for d in np.flatnonzero(counts).tolist():
        mine = inside[w.first[d] : w.first[d + 1]].view(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0]))))
        spans[d] = [{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]
    figures = (w.counts, _sums(SOLID[buf] & ((buf & 0xC0) != 0x80), off), _sums(SYMBOLS[buf], off), dup, _sums(covered(n, np.flatnonzero(longest >= 3), 3), w.first), counts, most)
    return {c: pa.array(x, pa.int64()) for c, x in zip(COUNTS, figures)} | {"repeat_spans": pa.array(spans, _SPANS)}


def score_quality(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """docs with the figures, base_failed, and kept: false if the base rule or a limit on repeats fails."""
    got = with_columns(docs, text, FIELDS, lambda: lambda texts: measure(texts, min_repeat))
    of = dict(zip(FIELDS.names, (F.col(c) for c in got.columns[len(docs.columns) :])))
    failed, kept = free_name(got, "base_failed"), free_name(got, "kept")
    got = got.withColumn(failed, (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"]))
    return got.withColumn(kept, ~F.col(failed) & (of["covered_words"] <= max_covered * of["n_words"]) & (of["longest_repeat"] <= max_longest))
