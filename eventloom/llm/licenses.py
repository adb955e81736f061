"""License scan by diagonal voting.

All rolling word k-grams of all texts are hashed and joined by Spark to the places of the templates' k-grams. A
match at word p of a text and t of a template votes for the diagonal p - t; votes are summed by text, template and
diagonal, and neighbouring diagonals (words put in or left out) are merged. Where enough of a template has voted,
the texts' words are aligned with the template's, word for word, and the template's label is given if enough agree.
Phrases that name a license outright are found beside it, and give labels of their own.

The templates' k-grams are joined by broadcast while there are at most MAX_BROADCAST of them, else by a shuffle.
Only matches are shuffled; texts are, once, where there are too many candidates to broadcast by Spark's own limit.

Null and empty texts have no words, labels or places; their score is 0. Votes of repeated ids are put together, but
every row's labels are verified on its own text. Templates of fewer than k words are refused. Very long texts are
scanned whole. Other columns of the table are left out, so no names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import ALNUM, Rolling, Texts, Words, blocks, extended, map_batches, word_windows
from eventloom.llm.license_texts import PHRASES, TEMPLATES
from eventloom.shared import materialize

K = 3
MAX_BROADCAST = 1 << 20
#: Words between diagonals that still belong together; the share of a template's k-grams that must have voted; the share of its words that must agree.
NEIGHBOURS, MIN_VOTES, MIN_AGREE = 8, 0.4, 0.8


def _words(text: str) -> list[bytes]:
    w = Words(Texts(pa.array([text])), ALNUM, lower=True)
    return [w.text(i, i + 1) for i in range(len(w.start))]


def template_grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int]]:
    """(hash, template, place) of all k-grams of the templates, of which each must have one."""
    w = Words(Texts(pa.array([t for _, t in templates])), ALNUM, lower=True)
    if templates and w.counts.min() < k:
        raise ValueError(f"a template of fewer than {k} words has no {k}-gram to be found by: {templates[int(w.counts.argmin())][0]}")
    h = word_windows(Rolling(w.buf).spans(w.start, w.end), k).view(np.int64)
    return [(int(x), int(d), int(i - w.first[d])) for i, (x, d) in enumerate(zip(h, w.doc)) if w.doc[i + k - 1] == d]


def grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, place, h) for every word k-gram of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", 1 << 20):
            w = Words(texts, ALNUM, lower=True)
            h = word_windows(Rolling(w.buf).spans(w.start, w.end), k)
            at = np.flatnonzero(w.doc[: len(h)] == w.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
            d = w.doc[at]
            ids = part.column(0).take(pa.array(d))
            yield pa.RecordBatch.from_arrays([ids, pa.array((at - w.first[d]).astype(np.int32)), pa.array(h[at].view(np.int64))], names=["doc_id", "place", "h"])

    return map_batches(docs, run, T.StructType([docs.schema["doc_id"], T.StructField("place", T.IntegerType()), T.StructField("h", T.LongType())]))


def candidates(docs: DataFrame, templates: list[tuple[str, str]], k: int = K, neighbours: int = NEIGHBOURS, min_votes: float = MIN_VOTES) -> DataFrame:
    """(doc_id, found): for each text with enough votes, (template, least diagonal, greatest diagonal, votes)."""
    spark = docs.sparkSession
    places = spark.createDataFrame(template_grams(templates, k), "h long, template int, at int")
    n_places = sum(max(0, len(_words(t)) - k + 1) for _, t in templates)
    sizes = spark.createDataFrame([(i, max(0, len(_words(t)) - k + 1)) for i, (_, t) in enumerate(templates)], "template int, n_grams int")
    if n_places <= MAX_BROADCAST:
        places, sizes = F.broadcast(places), F.broadcast(sizes)
    votes = grams(docs, k).join(places, "h").groupBy("doc_id", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    w = W.partitionBy("doc_id", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(w) > neighbours
    merged = (
        votes.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("band", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "template", "band").agg(F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.sum("votes").alias("votes"))
    )
    enough = merged.join(sizes, "template").where(F.col("votes") >= F.greatest(F.lit(1.0), min_votes * F.col("n_grams")))
    return enough.groupBy("doc_id").agg(F.collect_list(F.struct("template", "lo", "hi", "votes")).alias("found"))


def agreement(template: list[bytes], words: list[bytes]) -> tuple[float, int, int]:
    """The share of words that agree, of the template's or of the span's (whichever has more), and the span's ends."""
    hits = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    if not hits:
        return 0.0, 0, 0
    start, end = hits[0].b, hits[-1].b + hits[-1].size
    return sum(m.size for m in hits) / max(len(template), end - start), start, end


def best(spans: list[dict]) -> list[dict]:
    """Of spans that overlap and have different labels, those with most agreeing words."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (-(s["end"] - s["start"]) * s["score"], s["start"], s["label"])):
        if not any(o["label"] != s["label"] and o["start"] < s["end"] and s["start"] < o["end"] for o in kept):
            kept.append(s)
    return kept


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, k: int = K, min_agree: float = MIN_AGREE) -> DataFrame:
    """(doc_id, n_words, licenses) for each row of docs: spans of words with label and score (the share that agrees);
    base is true for spans of the phrases."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = materialize(candidates(rows, templates, k), "licenses")
    joined = rows.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left").drop("found_id")
    labels, bodies = [label for label, _ in templates], [_words(t) for _, t in templates]
    wanted = [(label, _words(p)) for label, p in phrases]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("licenses", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = []
        for label, words in wanted:
            w = Words(Texts(pa.array([b" ".join(words).decode()])), ALNUM)
            named.append((label, len(words), b" ".join(words), word_windows(Rolling(w.buf).spans(w.start, w.end), len(words))[0]))
        for part, texts in blocks(batches, "text"):
            w = Words(texts, ALNUM, lower=True)
            h = Rolling(w.buf).spans(w.start, w.end)
            spans: list[list[dict]] = [[] for _ in range(texts.n)]
            for size in {n for _, n, _, _ in named}:
                wh = word_windows(h, size)
                for label, n, words, value in named:
                    if n == size:
                        for i in np.flatnonzero(wh == value).tolist():
                            d = int(w.doc[i])
                            if w.doc[i + n - 1] == d and w.text(i, i + n) == words:
                                spans[d].append({"label": label, "start": i - int(w.first[d]), "end": i - int(w.first[d]) + n, "score": 1.0, "base": True})
            for d, bands in enumerate(part.column(2).to_pylist()):
                verified = []
                for x in bands or ():
                    body, a, n = bodies[x["template"]], int(w.first[d]), int(w.counts[d])
                    lo, hi = max(0, x["lo"]), min(n, x["hi"] + len(body))
                    if lo < hi:
                        share, s, e = agreement(body, [w.text(a + i, a + i + 1) for i in range(lo, hi)])
                        if share >= min_agree:
                            verified.append({"label": labels[x["template"]], "start": lo + s, "end": lo + e, "score": share, "base": False})
                spans[d] += best(verified)
            for x in spans:
                x.sort(key=lambda s: (s["start"], s["end"], s["label"], s["base"]))
            yield extended(part.select(["doc_id"]), {"n_words": pa.array(w.counts, pa.int64()), "licenses": pa.array(spans, _SPANS)})

    return map_batches(joined, run, schema)
