"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over all texts.

Every window of n words of a benchmark item (a shorter item is one window) goes into a set of arrays: the items'
words, joined by spaces, and for each window its rolling hash, first word and item. Each task runs the same rolling
hash over whole texts, verifies hits by comparing the words, and marks the words inside them.

The set is broadcast in parts of at most PART_BYTES of text, which take about four times that in arrays. A benchmark
of one part (any but very large ones) is one pass over the texts without a shuffle; of more, a pass for each, one
after another, each written to the shared folder, so that one part is alive at a time, on the driver too.

Null and empty texts have no words; null and empty items no windows. Repeated rows are treated alike, each
on its own; rows of one item id together make that item. Items with a null id are left out. Columns of docs that
have the names of the new ones stay, and the new names are lengthened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from eventloom.llm.common import ALNUM, Rolling, Texts, Words, blocks, extended, free_name, map_batches, ranges, word_windows
from eventloom.shared import materialize

#: Benchmark text in one broadcast part, in bytes.
PART_BYTES = 16 << 20


class WindowSet:
    """The word windows of some items' texts. Rows of one item must stand together."""

    def __init__(self, n: int, items: list[str], texts: list[str]):
        self.n = n
        w = Words(Texts(pa.array(texts, pa.string())), ALNUM, lower=True)
        number = np.cumsum([0, *(a != b for a, b in zip(items, items[1:]))]) if items else np.zeros(0, np.int64)
        self.items = [x for i, x in enumerate(items) if not i or items[i - 1] != x]
        size = w.end - w.start
        #: Where each word begins in the joined text.
        self.begin = np.concatenate(([0], np.cumsum(size + 1)))
        joined = np.full(int(self.begin[-1]), 32, np.uint8)
        joined[ranges(self.begin[:-1], size)] = w.buf[ranges(w.start, size)]
        self.text = joined.tobytes()
        h = Rolling(w.buf).spans(w.start, w.end)
        #: For each size of windows: their hashes, sorted, and the first word and the item of each.
        self.sizes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.unique(np.minimum(w.counts[w.counts > 0], n)).tolist():
            wh = word_windows(h, k)
            at = np.flatnonzero(w.doc[: len(wh)] == w.doc[k - 1 :])
            if k < n:
                at = at[w.counts[w.doc[at]] == k]
            at = at[np.argsort(wh[at], kind="stable")]
            self.sizes.append((k, wh[at], at.astype(np.uint32), number[w.doc[at]].astype(np.uint32)))

    def window(self, first: int, size: int) -> bytes:
        return self.text[self.begin[first] : self.begin[first + size] - 1]


class Scanner:
    """Finds a set's windows in blocks of texts."""

    def __init__(self, windows: WindowSet):
        self.set = windows
        self.low: list[np.ndarray] = []
        for _, hashes, _, _ in windows.sizes:
            bits = np.zeros(1 << min(22, max(12, (8 * len(hashes)).bit_length())), bool)
            bits[hashes & np.uint64(len(bits) - 1)] = True
            self.low.append(bits)
        #: Windows that have been hit: (size, place of the hash) -> their words -> numbers of items.
        self.known: dict[tuple[int, int], dict[bytes, set[int]]] = {}

    def _items(self, k: int, lo: int, hi: int, words: bytes) -> set[int] | None:
        size, _, first, item = self.set.sizes[k]
        if (k, lo) not in self.known:
            held = self.known[k, lo] = {}
            for f, i in zip(first[lo:hi].tolist(), item[lo:hi].tolist()):
                held.setdefault(self.set.window(f, size), set()).add(i)
        return self.known[k, lo].get(words)

    def scan(self, texts: Texts) -> tuple[Words, np.ndarray, list[set[int]]]:
        """The words of a block, which of them are hit, and the items found in each text."""
        w = Words(texts, ALNUM, lower=True)
        h = Rolling(w.buf).spans(w.start, w.end)
        edge = np.zeros(len(h) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(texts.n)]
        seen: set[tuple[int, int, bytes]] = set()
        for k, (size, hashes, _, _) in enumerate(self.set.sizes):
            wh = word_windows(h, size)
            at = np.flatnonzero(self.low[k][wh & np.uint64(len(self.low[k]) - 1)])
            at = at[w.doc[at] == w.doc[at + size - 1]]
            lo, hi = np.searchsorted(hashes, wh[at]), np.searchsorted(hashes, wh[at], "right")
            hit = hi > lo
            for i, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                words = w.text(i, i + size)
                items = self._items(k, a, b, words)
                if items is None:
                    continue
                edge[i] += 1
                edge[i + size] -= 1
                d = int(w.doc[i])
                if (d, k, words) not in seen:
                    seen.add((d, k, words))
                    found[d] |= items
        return w, np.cumsum(edge[:-1]) > 0, found


def _parts(benchmark: DataFrame, item: str, text: str, n: int, part_bytes: int) -> Iterator[WindowSet]:
    """The benchmark in sets of bounded size; rows of an item stand together, and never all rows are held at once."""
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).orderBy("i")
    items: list[str] = []
    texts: list[str] = []
    size = 0
    for i, t in rows.toLocalIterator():
        if size >= part_bytes:
            yield WindowSet(n, items, texts)
            items, texts, size = [], [], 0
        items.append(i)
        texts.append(t)
        size += len(t.encode())
    yield WindowSet(n, items, texts)


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

#: What becomes of a block: its rows, texts and words, and the runs and items of each text.
Finish = Callable[[pa.RecordBatch, Texts, Words, list, list], pa.RecordBatch]


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, n: int, part_bytes: int, names: list[str], finish: Finish, schema: T.StructType) -> DataFrame:
    """docs after the passes of all parts; finish makes the rows of the last one."""
    spark = docs.sparkSession
    added = [T.StructField(names[0], T.ArrayType(RUN)), T.StructField(names[1], T.ArrayType(T.StringType()))]

    def scanning(shared, first: bool, out: Finish):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(shared.value)
            ids = shared.value.items
            for part, texts in blocks(batches, text):
                w, hit, found = scanner.scan(texts)
                before = [None] * texts.n if first else part.column(names[0]).to_pylist()
                held = [()] * texts.n if first else part.column(names[1]).to_pylist()
                runs: list[list] = [[] for _ in range(texts.n)]
                for d in {i for i, x in enumerate(found) if x} | {i for i, x in enumerate(before) if x}:
                    mine = hit[w.first[d] : w.first[d + 1]].copy()
                    for r in before[d] or ():
                        mine[r["start"] : r["end"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                    runs[d] = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                items = [sorted({*old, *(ids[k] for k in x)}) if old or x else [] for old, x in zip(held, found)]
                yield out(part if first else part.select([c for c in part.schema.names if c not in names]), texts, w, runs, items)

        return run

    def kept(part: pa.RecordBatch, texts: Texts, w: Words, runs: list, items: list) -> pa.RecordBatch:
        return extended(part, {names[0]: pa.array(runs, _RUNS), names[1]: pa.array(items, pa.list_(pa.string()))})

    out, first, last = docs, True, None
    for windows in _parts(benchmark, item, item_text, n, part_bytes):
        if last is not None:
            shared = spark.sparkContext.broadcast(last)
            out = materialize(map_batches(out, scanning(shared, first, kept), T.StructType([*docs.schema.fields, *added])), "windows")
            shared.destroy()
            first = False
        last = windows
    return map_batches(out, scanning(spark.sparkContext.broadcast(last), first, finish), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 8, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with bench_words (count), bench_runs (hit words as runs of word numbers, end exclusive) and bench_items (sorted ids as strings)."""
    names = [free_name(docs, x) for x in ("bench_words", "bench_runs", "bench_items")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(RUN)), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def finish(part: pa.RecordBatch, texts: Texts, w: Words, runs: list, items: list) -> pa.RecordBatch:
        return extended(part, {names[0]: pa.array(w.counts, pa.int64()), names[1]: pa.array(runs, _RUNS), names[2]: pa.array(items, pa.list_(pa.string()))})

    return _scanned(docs, benchmark, text, item, item_text, n, part_bytes, names[1:], finish, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_items: int = 2, item: str = "item_id", item_text: str = "text", n: int = 8, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without texts that hold windows of min_items items or more; hits in the others are cut out of their texts.

    A cut goes from the first to the last byte of a run of hit words. Clean texts stay as they are.
    """
    names = [free_name(docs, x) for x in ("bench_runs", "bench_items")]
    at = docs.columns.index(text)

    def finish(part: pa.RecordBatch, texts: Texts, w: Words, runs: list, items: list) -> pa.RecordBatch:
        stays = [len(x) < min_items for x in items]
        if any(runs):
            values = part.column(at).to_pylist()
            for d, mine in enumerate(runs):
                if mine and stays[d]:
                    raw, a, base = texts.bytes(d), int(w.first[d]), int(texts.off[d])
                    pieces, done = [], 0
                    for r in mine:
                        pieces.append(raw[done : w.start[a + r["start"]] - base])
                        done = w.end[a + r["end"] - 1] - base
                    values[d] = b"".join([*pieces, raw[done:]]).decode()
            columns = list(part.columns)
            columns[at] = pa.array(values, part.column(at).type)
            part = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        return part if all(stays) else part.filter(pa.array(stays))

    return _scanned(docs, benchmark, text, item, item_text, n, part_bytes, names, finish, docs.schema)
