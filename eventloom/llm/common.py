"""Shared pieces: blocks of whole texts as byte arrays, word spans, rolling hashes, shared tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Rows of an Arrow batch. Texts are long, and the JVM and the worker each hold a batch whole.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

U64 = np.uint64


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes of words of letters and digits: 0-9, a-z (texts are lower-cased first) and all of any character beyond ASCII.
ALNUM = _table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Bytes of words between white space.
SOLID = ~_table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def give_back() -> None:
    """Return what a task has freed to the system: workers are used again, and what one stage grew would stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded memory.

    Where the session has Spark's own number of rows in an Arrow batch, it is set to BATCH_ROWS; a number that the
    user has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == "10000":
        conf.set(_BATCH_CONF, str(BATCH_ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the columns that df reads, as Spark estimates them from the files; of tables without files none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)  # Spark's word for an unknown size is more than that


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files removed that no live plan refers to any more.

    Plans live as long as Python holds their proxies, and Spark's cleaner acts on what the JVM has collected. It
    never removes files of a shuffle that a stage could still ask for: what read them has been written to the
    shared folder, and is read from there when a task is run again.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# ---------------------------------------------------------------- blocks of texts


class Texts:
    """Texts of a slice of a batch, as one byte array and offsets; a null text is empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        _, off, data = column.buffers()
        n = len(column)
        kind = np.int64 if wide else np.int32
        self.off = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        lo, hi = int(self.off[0]), int(self.off[-1])
        self.buf = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
        self.off = self.off - lo
        self.n = n

    def bytes(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most so many bytes of text each (or a single text)."""
    for batch in batches:
        k = batch.schema.get_field_index(text)
        whole = Texts(batch.column(k))
        at = 0
        while at < whole.n:
            to = max(at + 1, int(np.searchsorted(whole.off, whole.off[at] + most, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, Texts(part.column(k))
            at = to


def extended(part: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *added.values()], names=[*part.schema.names, *added])


def with_columns(df: DataFrame, text: str, fields: T.StructType, each: Callable[[], Callable[[Texts], dict[str, pa.Array]]]) -> DataFrame:
    """df with columns computed from whole texts, a block at a time and without a shuffle.

    each: called once in every task, gives the function of a block. It must return the fields in their order.
    Names that df has already are lengthened, so no column of df is lost; the new ones are the last.
    """
    names: list[str] = []
    for f in fields.fields:
        name = free_name(df, f.name)
        while name.lower() in {x.lower() for x in names}:
            name += "_"
        names.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = each()
        for part, texts in blocks(batches, text):
            yield extended(part, dict(zip(names, of(texts).values(), strict=True)))

    added = [T.StructField(name, f.dataType, f.nullable) for name, f in zip(names, fields.fields)]
    return map_batches(df, run, T.StructType([*df.schema.fields, *added]))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... size of them, for each pair."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal size at a and b hold the same bytes, for each pair."""
    out = np.ones(len(a), bool)
    step = 1 << 16  # pairs at once, to bound the indexes
    for i in range(0, len(a), step):
        n = size[i : i + step].astype(np.int64)
        unlike = buf[ranges(a[i : i + step], n)] != buf[ranges(b[i : i + step], n)]
        out[i + np.repeat(np.arange(len(n)), n)[unlike]] = False
    return out


def span_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span, equal for spans of the same bytes and for no others.

    Spans are grouped by hash and size, and each is compared with the first of its group byte for byte; where that
    fails for any, all are told apart by their bytes.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    size = end - start
    order = np.lexsort((start, size, hashes))
    new = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (size[order][1:] != size[order][:-1])))
    heads = order[np.flatnonzero(new)]
    group = np.cumsum(new) - 1
    rest = np.flatnonzero(~new)
    if not same_spans(buf, start[order[rest]], start[heads[group[rest]]], size[order[rest]]).all():
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
    ids = np.empty(n, np.int64)
    ids[order] = group
    return ids


# ---------------------------------------------------------------- words


class Words:
    """Start and end bytes of the words of a block, in order; words never cross texts."""

    def __init__(self, texts: Texts, inside: np.ndarray, lower: bool = False):
        self.buf = LOWER[texts.buf] if lower else texts.buf
        w = inside[self.buf]
        size = len(w)
        first = np.zeros(size + 1, bool)
        first[texts.off] = True
        first = first[:size]
        if size:
            before = np.empty(size, bool)
            before[0] = False
            before[1:] = w[:-1]
            before &= ~first
            self.start = np.flatnonzero(w & ~before)
            after = np.empty(size, bool)
            after[-1] = False
            after[:-1] = w[1:] & ~first[1:]
            self.end = np.flatnonzero(w & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: The first word of each text, and one past the last of all.
        self.first = np.searchsorted(self.start, texts.off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.counts)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by single spaces."""
        buf, s, e = self.buf, self.start, self.end
        return b" ".join([buf[s[i] : e[i]].tobytes() for i in range(a, b)])


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random odd value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BASE = U64(0x2545F4914F6CDD1D)
with np.errstate(over="ignore"):
    UNBASE = U64(pow(int(BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any span of a block in constant time, from prefix sums of a polynomial modulo 2**64."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            size = max(n, BLOCK_BYTES + (1 << 16))
            out = []
            for base in (BASE, UNBASE):
                p = np.full(size, base, U64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=U64))
            cls._powers = (out[0], out[1])
        return cls._powers

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = self.powers(n + 1)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUE[buf] * up[:n], dtype=U64, out=self.sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of so many bytes, by start."""
        n = len(self.sum) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sum[size:] - self.sum[:n]) * self.down[:n])


def word_windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of size successive word hashes, by first word: each word's bits are turned by its place, and added up."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, size, U64)
    for k in range(size):
        turn, part = U64(11 * k % 64), words[k : k + n]
        total += (part << turn) | (part >> (U64(64) - turn)) if turn else part
    return mix(total)


def strings(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.string())
