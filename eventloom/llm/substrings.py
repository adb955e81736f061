"""Suffix-array dedup of exact substrings of `length` bytes or more, over all documents.

Suffixes are sampled: of each window of `length` bytes, the place whose k-byte gram hashes least is an anchor, so
equal windows have equal anchors at equal offsets. An anchor's context is all bytes that windows around it reach.

1. Anchors of some texts are combined in the task (a context once, at its smallest id), and dealt out by
   their gram. Where a context stands in a smaller document, all of it is covered there, and only the context's
   first document needs a closer look. It gets one where the gram has other contexts too.
2. Contexts to look at are cut from the texts and meet by their gram. All windows in them are suffixes, put in
   order by deep-shallow sorting: multikey quicksort on eight bytes at a time down to a shallow depth; groups that
   still agree go into blind tries, which branch on the first bit in which a group differs, until none does.
   Neighbours with `length` bytes in common are repeats; those of a larger id than the least are covered.
3. Documents join what is covered in them, find their anchors again, and the covered bytes go.

A gram with many contexts (a passage or line in very many documents) is not dealt out by itself: its windows are
dealt out by their own hashes, after each block has combined equal ones, so no gram fills a task. Records are dealt
to parts whose number grows with the input's bytes, so the share of a task does not.

Whole contexts (at most 2 * length - gram + 1 bytes) that agree in 112 bits of hash are taken as equal, and so are
windows of hot grams that agree in 96: comparing their bytes would send each text several times over. At 10^12
contexts the chance of one wrong match is below 10^-9 and 10^-4.

Ids are whole numbers, for the order of documents. Null and empty texts have no bytes. Rows with a null id keep all their bytes and remove none elsewhere. Repeated
rows of one id do not remove from each other. Matches never cross documents, and are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import U64, Rolling, Texts, blocks, extended, free_name, input_bytes, map_batches, mix, ranges, release_shuffles
from eventloom.shared import materialize

GRAM = 20
SHALLOW = 32
#: Contexts of a gram in a block, and in all, beyond which its windows are dealt out one by one.
BLOCK_CONTEXTS, ALL_CONTEXTS = 32, 512
#: Bytes of text that anchors are found in at once, and anchors that are combined at once.
SCAN_BYTES, COMBINED = 1 << 20, 1 << 19
#: Bytes of stored input for each part that records are dealt out to, so that a task holds a bounded share of any input.
PART_BYTES = 16 << 20

_NONE = np.uint32(0xFFFFFFFF)
MARKS = pa.schema([("doc_id", pa.int64()), ("kind", pa.int8()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("blob", pa.binary())])
_DEALT_SQL = "bucket int, kind byte, doc_id long, c long, lo int, hi int, blob binary"
_MARKS_SQL = "doc_id long, kind byte, c long, lo int, hi int"
#: Kinds of rows: covered bytes of a text; covered bytes around a context; a context to look at (hi: 1 if its gram is hot); packed arrays, of all and of hot grams.
#: Grams are dealt out by 48 bits of their hashes: a clash only makes contexts be looked at in vain.
SPAN, COVER, REQUEST, PACKED, PACKED_HOT = range(5)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; signed longs as differences from their least, in as few bytes as these need."""
    out = []
    for a in arrays:
        if a.dtype == np.int64:
            least = int(a.min()) if len(a) else 0
            a = (a - least).view(U64)
            most = int(a.max()) if len(a) else 0
            out.append(b"-" + np.int64(least).tobytes())
            a = a.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else U64)
        out += [a.dtype.char.encode(), np.int64(len(a)).tobytes(), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at, least = [], 0, None
    while at < len(blob):
        if blob[at : at + 1] == b"-":
            least, at = np.frombuffer(blob, np.int64, 1, at + 1)[0], at + 9
            continue
        kind, n = np.dtype(blob[at : at + 1].decode()), int(np.frombuffer(blob, np.int64, 1, at + 1)[0])
        a = np.frombuffer(blob, kind, n, at + 9)
        out.append(a if least is None else a.astype(U64).view(np.int64) + least)
        least = None
        at += 9 + n * kind.itemsize
    return out


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    s = 1
    while s * 2 <= w:
        a = op(a[:-s], a[s:])
        s *= 2
    return op(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


class Anchors:
    """The anchors of a block: place, text, gram hash, context hash, and the ends of the context."""

    def __init__(self, texts: Texts, length: int, gram: int):
        n = len(texts.buf)
        self.roll = roll = Rolling(texts.buf)
        self.off = off = texts.off
        doc = np.repeat(np.arange(texts.n), np.diff(off))
        reach = length - gram
        if n < length:
            empty = np.zeros(0, np.int64)
            self.at, self.doc, self.lo, self.hi = empty, empty, empty, empty
            self.g = self.c = np.zeros(0, U64)
            self.order = self.least = np.zeros(0, np.uint32)
            return
        g = roll.windows(gram)
        till = off[1:][doc]
        order = (g >> U64(32)).astype(np.uint32) | np.uint32(1)
        order[np.arange(gram, gram + len(g)) > till[: len(g)]] = _NONE
        least = _slide(order, reach + 1, np.minimum)
        least[np.arange(length, length + len(least)) > till[: len(least)]] = 0
        edge = np.zeros(reach, np.uint32)
        self.at = at = np.flatnonzero((_slide(np.concatenate((edge, least, edge)), reach + 1, np.maximum) == order) & (order != _NONE))
        self.order, self.least = order, least
        self.doc = doc[at]
        self.g = g[at]
        self.lo, self.hi = np.maximum(at - reach, off[self.doc]), np.minimum(at + length, till[at])
        self.c = mix(roll.spans(self.lo, self.hi) + (at - self.lo).astype(U64) * U64(0x9E3779B97F4A7C15) + (self.hi - at).astype(U64) * U64(0xC2B2AE3D27D4EB4F))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor, the first and one past the last start of the windows that have it as their first least gram."""
        j = np.flatnonzero(self.least)
        k = np.searchsorted(self.at, j)
        todo = np.arange(len(j))
        while len(todo):
            todo = todo[self.order[self.at[k[todo]]] != self.least[j[todo]]]
            k[todo] += 1
        first, last = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        first[k[new]] = j[new]
        last[k[new]] = j[np.append(new[1:], len(k)) - 1] + 1 if len(k) else 0
        return first, last


def runs(inside: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, as rows."""
    return np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])))).reshape(-1, 2)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def deep_shallow(buf: np.ndarray, start: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """The rank of each string of `length` bytes of buf; equal strings share the rank of their first."""
    n = len(start)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))

    def word(at: np.ndarray) -> np.ndarray:
        return padded[at[:, None] + np.arange(8)].view(">u8").astype(np.uint64).ravel()

    rank = np.zeros(n, np.int64)
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    # Shallow: multikey quicksort, with eight bytes as a character.
    for depth in range(0, min(shallow, length - length % 8), 8):
        if not len(active):
            break
        key = word(start[active] + depth)
        o = np.lexsort((key, rank[active]))
        active, key = active[o], key[o]
        first = rank[active]
        active, _ = _split(rank, active, first, _heads(first, key))
    # Deep: blind tries. A group's node branches on the first bit that differs in it; what agrees is skipped.
    if len(active):
        depths = [*range(shallow, length - 7, 8)]
        if (length - shallow) % 8 or not depths:
            depths.append(length - 8)
        rest = np.stack([word(start[active] + d) for d in depths])
        while len(active):
            heads = np.flatnonzero(_heads(rank[active]))
            sizes = np.diff(np.append(heads, len(active)))
            bit = np.zeros(len(active), bool)
            open_ = np.ones(len(heads), bool)
            for w in rest:
                d = np.bitwise_or.reduceat(w, heads) ^ np.bitwise_and.reduceat(w, heads)
                top = d.copy()
                for s in (1, 2, 4, 8, 16, 32):
                    top |= top >> np.uint64(s)
                top ^= top >> np.uint64(1)
                mine = open_ & (d != 0)
                bit |= np.repeat(mine, sizes) & ((w & np.repeat(top, sizes)) != 0)
                open_ &= ~mine
            differs = np.repeat(~open_, sizes)
            active, bit, rest = active[differs], bit[differs], rest[:, differs]
            o = np.lexsort((bit, rank[active]))
            active, bit, rest = active[o], bit[o], rest[:, o]
            first = rank[active]
            active, kept = _split(rank, active, first, _heads(first, bit))
            rest = rest[:, kept]
    return rank


def _split(rank: np.ndarray, active: np.ndarray, first: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set the ranks of the parts that sorted groups fall into; gives the members of parts of two or more."""
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(active)))
    group = np.flatnonzero(_heads(first))
    begin = np.repeat(group, np.diff(np.append(group, len(first))))
    rank[active] = np.repeat(first[heads] + heads - begin[heads], sizes)
    kept = np.repeat(sizes > 1, sizes)
    return active[kept], kept


def _rows(kind: int, doc: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    return [pa.array(doc.astype(np.int64)), pa.array(np.full(len(doc), kind, np.int8)), pa.array(c.astype(U64).view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]


def _straight(parts: int, kind: int, doc: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows that only pass through the exchange."""
    d, k, *rest = _rows(kind, doc, c, lo, hi)
    bucket = (mix(doc.astype(np.int64).view(U64)) % U64(parts)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), k, d, *rest, pa.nulls(len(doc), pa.binary())], schema=_DEALT)


def _packed(kind: int, buckets: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(n, kind, np.int8)), none, none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(blobs, pa.binary())], schema=_DEALT)


def _dealt(kind: int, parts: int, key: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch | None:
    """Arrays cut by the bucket of their key, packed."""
    if not len(key):
        return None
    bucket = (mix(key) % U64(parts)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[o], [a[o] for a in arrays]
    at = np.append(np.flatnonzero(_heads(bucket)), len(bucket))
    return _packed(kind, bucket[at[:-1]], [pack(*(a[x:y] for a in arrays)) for x, y in zip(at[:-1].tolist(), at[1:].tolist())])


def intervals(doc: np.ndarray, c: np.ndarray, t: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows at t around a context, united where they follow each other."""
    o = np.lexsort((t, c, doc))
    doc, c, t = doc[o], c[o], t[o]
    new = _heads(doc, c)
    if len(t):
        new[1:] |= np.diff(t) > 1
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(t)) - 1
    return doc[heads], c[heads], t[heads], t[ends] + length


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[list[np.ndarray]], list[list[np.ndarray]]]:
    straight, packed, hot = [], [], []
    for b in batches:
        kind = b.column(1).to_numpy()
        plain = np.flatnonzero(kind < PACKED)
        if len(plain):
            part = b.take(pa.array(plain))
            straight.append(pa.RecordBatch.from_arrays([part.column(k) for k in (2, 1, 3, 4, 5)], schema=MARKS))
        for k, to in ((PACKED, packed), (PACKED_HOT, hot)):
            to += [unpack(x) for x in b.column(6).take(pa.array(np.flatnonzero(kind == k))).to_pylist()]
    return straight, packed, hot


def _deal(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("bucket"))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM) -> DataFrame:
    """(doc_id, marks) for documents with bytes to remove; marks are (c, lo, hi): bytes lo to hi of the text where c is
    null, else of the places with context c, counted from the anchor."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PART_BYTES)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    reach = length - gram

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_here: np.ndarray = np.zeros(0, U64)
        held: list[tuple[np.ndarray, ...]] = []
        n_rows = size = 0

        def combined() -> Iterator[pa.RecordBatch]:
            nonlocal hot_here
            g, c, d, row, lo, hi = (np.concatenate(a) for a in zip(*held))
            held.clear()
            o = np.lexsort((d, c, g))
            g, c, d = g[o], c[o], d[o]
            new = _heads(g, c)
            heads = np.flatnonzero(new)
            later = o[d > d[heads][np.cumsum(new) - 1]]
            # Contexts that a smaller document has here are covered; what they cover of a text is united.
            if len(later):
                later.sort()  # back in the order of texts and places
                r, a, b = row[later], lo[later], hi[later]
                new = _heads(r)
                new[1:] |= a[1:] > b[:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(r)) - 1
                ids = np.empty(len(o), np.int64)
                ids[o] = d
                yield _straight(parts, SPAN, ids[later[first]], np.zeros(len(first), U64), a[first], b[last])
            g, c, d = g[heads], c[heads], d[heads]
            # Grams with very many contexts in this task: all of them are looked at, and one record says so.
            new = _heads(g)
            many = np.bincount(np.cumsum(new) - 1) > BLOCK_CONTEXTS if len(g) else np.zeros(0, bool)
            fresh = np.setdiff1d(g[new][many], hot_here)
            hot_here = np.union1d(hot_here, fresh)
            hot = np.isin(g, hot_here)
            if hot.any():
                yield _straight(parts, REQUEST, d[hot], c[hot], np.zeros(hot.sum()), np.ones(hot.sum()))
            for kind, key, arrays in ((PACKED, g[~hot], [c[~hot], d[~hot]]), (PACKED_HOT, fresh, [])):
                out = _dealt(kind, parts, key, [(key >> U64(16)).astype(np.uint32), key.astype(np.uint16), *arrays])
                if out:
                    yield out

        for part, texts in blocks(batches, "text", SCAN_BYTES):
            x = Anchors(texts, length, gram)
            begin = texts.off[x.doc]
            held.append((x.g >> U64(16), x.c, part.column(0).to_numpy()[x.doc], (n_rows + x.doc).astype(np.int32), *((a - begin).astype(np.int32) for a in (x.lo, x.hi))))
            n_rows += texts.n
            size += len(x.at)
            del x
            if size >= COMBINED:
                yield from combined()
                size = 0
        if held:
            yield from combined()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        straight, packed, says = _gather(batches)
        yield from straight
        if not packed:
            return
        high, low, c, d = (np.concatenate(a) for a in zip(*packed))
        del packed
        g = high.astype(U64) << U64(16) | low
        hot = np.unique(np.concatenate([h.astype(U64) << U64(16) | low for h, low in says])) if says else g[:0]
        o = np.lexsort((d, c, g))
        g, c, d = g[o], c[o], d[o]
        new = _heads(g, c)
        heads = np.flatnonzero(new)
        if not len(heads):
            return
        later = d > d[heads][np.cumsum(new) - 1]
        if later.any():
            n = int(later.sum())
            # The same context of one document may come from several blocks only where rows are repeated.
            yield pa.RecordBatch.from_arrays(_rows(COVER, d[later], c[later], np.full(n, -reach), np.full(n, length)), schema=MARKS)
        g, c, d = g[heads], c[heads], d[heads]
        at = np.flatnonzero(_heads(g))
        size = np.diff(np.append(at, len(g)))
        is_hot = np.isin(g[at], hot) | (size > ALL_CONTEXTS)
        look = is_hot | ((size > 1) & (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)))
        look, is_hot = np.repeat(look, size), np.repeat(is_hot, size)
        if look.any():
            yield pa.RecordBatch.from_arrays(_rows(REQUEST, d[look], c[look], np.zeros(look.sum()), is_hot[look]), schema=MARKS)

    first = materialize(map_batches(_deal(map_batches(rows, anchored, _DEALT_SQL), parts), grouped, _MARKS_SQL), "anchors")
    release_shuffles(spark)

    # The texts of documents with contexts to look at. The small side of the join is hashed, so texts are not sorted.
    requests = first.where(F.col("kind") == REQUEST).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("c"), F.col("hi").alias("hot"))).alias("asked"))
    asked = rows.join(requests.hint("shuffle_hash"), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", SCAN_BYTES):
            ids = part.column(0).to_numpy()
            x = Anchors(texts, length, gram)
            begin, end = x.windows()
            wanted = part.column(2)
            n = wanted.value_lengths().to_numpy()
            flat = wanted.flatten()
            key = _in_doc(np.repeat(np.arange(texts.n), n), flat.field(0).to_numpy().view(U64))
            is_hot = flat.field(1).to_numpy()
            own = _in_doc(x.doc, x.c)
            o = np.argsort(key)
            got = np.minimum(np.searchsorted(key[o], own), max(len(key) - 1, 0))
            mine = np.flatnonzero(key[o][got] == own) if len(key) else np.zeros(0, np.int64)
            # Each context of a text once.
            _, once = np.unique(own[mine], return_index=True)
            mine = mine[np.sort(once)]
            mine = mine[end[mine] > begin[mine]]
            hot = is_hot[o][got[mine]] > 0
            cold, warm = mine[~hot], mine[hot]
            if len(cold):
                a, b = begin[cold], end[cold] + length - 1
                bucket = (mix(x.g[cold]) % U64(parts)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                cold, a, b, bucket = cold[o], a[o], b[o], bucket[o]
                raw = ranges(a, b - a)
                ends = np.concatenate(([0], np.cumsum(b - a)))
                at = np.append(np.flatnonzero(_heads(bucket)), len(bucket)).tolist()
                d, c, t = ids[x.doc[cold]], x.c[cold], (a - x.at[cold]).astype(np.int32)
                size, raw = (b - a).astype(np.int32), texts.buf[raw]
                yield _packed(PACKED, bucket[at[:-1]], [pack(d[i:j], c[i:j], t[i:j], size[i:j], raw[ends[i] : ends[j]]) for i, j in zip(at, at[1:])])
            if len(warm):
                size = end[warm] - begin[warm]
                j = ranges(begin[warm], size)
                who = np.repeat(warm, size)
                d, c, t = ids[x.doc[who]], x.c[who], (j - x.at[who]).astype(np.int32)
                h, h2 = x.roll.spans(j, j + length), x.roll.spans(j, j + length // 2).astype(np.uint32)
                o = np.lexsort((d, h2, h))
                h, h2, d, c, t = h[o], h2[o], d[o], c[o], t[o]
                new = _heads(h, h2)
                later = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
                if later.any():
                    yield _straight(parts, COVER, *intervals(d[later], c[later], t[later], length))
                out = _dealt(PACKED_HOT, parts, h[~later], [a[~later] for a in (h, h2, d, c, t)])
                if out:
                    yield out

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        straight, packed, hot = _gather(batches)
        yield from straight
        if packed:
            d, c, t, size, raw = (np.concatenate(a) for a in zip(*packed))
            del packed
            n = size.astype(np.int64) - length + 1
            begin = np.concatenate(([0], np.cumsum(size[:-1], dtype=np.int64)))
            start = ranges(begin, n)
            of = np.repeat(np.arange(len(n)), n)
            rank = deep_shallow(raw, start, length)
            least = np.full(len(rank), np.iinfo(np.int64).max)
            np.minimum.at(least, rank, d[of])
            later = np.flatnonzero(d[of] > least[rank])
            if len(later):
                yield pa.RecordBatch.from_arrays(_rows(COVER, *intervals(d[of[later]], c[of[later]], (t[of] + start - begin[of])[later], length)), schema=MARKS)
        if hot:
            h, h2, d, c, t = (np.concatenate(a) for a in zip(*hot))
            o = np.lexsort((d, h2, h))
            h, h2, d, c, t = h[o], h2[o], d[o], c[o], t[o]
            new = _heads(h, h2)
            later = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            if later.any():
                yield pa.RecordBatch.from_arrays(_rows(COVER, *intervals(d[later], c[later], t[later], length)), schema=MARKS)

    second = materialize(map_batches(_deal(map_batches(asked, cut, _DEALT_SQL), parts), ordered, _MARKS_SQL), "windows")
    release_shuffles(spark)
    marks = first.where(F.col("kind") != REQUEST).unionByName(second)
    mark = F.struct(F.when(F.col("kind") == COVER, F.col("c")).alias("c"), "lo", "hi")
    return marks.groupBy("doc_id").agg(F.collect_list(mark).alias("marks"))


def _in_doc(doc: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(c + doc.astype(U64) * U64(0x9E3779B97F4A7C15))


REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM) -> DataFrame:
    """docs with removed (maximal runs of bytes, end exclusive) and kept (the other bytes of the text)."""
    marked = find_repeats(docs, doc_id, text, length, gram)
    name, key, removed, kept = (free_name(docs, x) for x in ("marks", "marks_id", "removed", "kept"))
    marked = marked.select(F.col("doc_id").alias(key), F.col("marks").alias(name))
    joined = docs.join(marked.hint("shuffle_hash"), docs[doc_id] == marked[key], "left").drop(key)
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, REMOVED), T.StructField(kept, T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, text, SCAN_BYTES):
            wanted = part.column(name)
            part = part.select([c for c in part.schema.names if c != name])
            n = np.nan_to_num(wanted.value_lengths().fill_null(0).to_numpy()).astype(np.int64)
            size = len(texts.buf)
            edge = np.zeros(size + 1, np.int64)
            if n.sum():
                flat = wanted.flatten()
                doc = np.repeat(np.arange(texts.n), n)
                lo, hi = flat.field(1).to_numpy().astype(np.int64), flat.field(2).to_numpy().astype(np.int64)
                context = flat.field(0)
                span = context.is_null().to_numpy(zero_copy_only=False)
                np.add.at(edge, texts.off[doc[span]] + lo[span], 1)
                np.add.at(edge, texts.off[doc[span]] + hi[span], -1)
                if not span.all():
                    x = Anchors(texts, length, gram)
                    key = _in_doc(doc[~span], context.fill_null(0).to_numpy()[~span].view(U64))
                    o = np.argsort(key)
                    key, lo, hi = key[o], lo[~span][o], hi[~span][o]
                    own = _in_doc(x.doc, x.c)
                    a, b = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                    mine = np.flatnonzero(b > a)
                    k = ranges(a[mine], (b - a)[mine])
                    who = np.repeat(mine, (b - a)[mine])
                    np.add.at(edge, np.maximum(x.at[who] + lo[k], x.lo[who]), 1)
                    np.add.at(edge, np.minimum(x.at[who] + hi[k], x.hi[who]), -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = texts.buf[~gone]
            at = np.concatenate(([0], np.cumsum(~gone)))[texts.off]
            raw = left.tobytes()
            spans: list[list] = [[] for _ in range(texts.n)]
            counts = np.diff(np.concatenate(([0], np.cumsum(gone)))[texts.off])
            for d in np.flatnonzero(counts).tolist():
                spans[d] = [{"start": s, "end": e} for s, e in runs(gone[texts.off[d] : texts.off[d + 1]]).tolist()]
            ends = at.tolist()
            yield extended(part, {removed: pa.array(spans, kind), kept: pa.array([raw[s:e] for s, e in zip(ends, ends[1:])], pa.binary())})

    return map_batches(joined, run, schema)
