"""Cost-balanced packing of tokenized documents into sequences of a fixed number of tokens.

Every task packs the documents it reads, in groups of a bounded number of tokens, so nothing is shuffled and no
group grows with the input. Whole stretches of `size` tokens are sequences by themselves. The rests of a group
go, longest first, each to the sequence of least cost that has room for it; the cost of a piece is linear in its
tokens plus quadratic, as attention's. Rests that fit nowhere whole are cut to fill what room is left. What is
over goes on to the next group; at a task's end it fills sequences of power-of-two sizes, which need no padding.

Null and empty texts are the end token alone. Repeated rows are packed each on its own. Every token lies in
exactly one piece. Sequence ids hold the partition's number, so a task that is run again gives the same ones.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import Texts, blocks, map_batches

SIZE = 1024
GROUP_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
END = 0


@functools.lru_cache(2)
def encoder(vocabulary: str, ranks: str | None, pattern: str | None) -> Callable[[Texts], Iterator[np.ndarray]]:
    """Ids of each text of a block by the tokenizer in the file vocabulary. Made once a worker.

    ranks: the same vocabulary as ranks, for texts on whose characters both libraries agree (below U+0280, and no
    special token inside); these are most texts, and encoded several times as fast.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    special = [x.content.encode() for x in whole.get_added_tokens_decoder().values()]
    fast = None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def of(texts: Texts) -> Iterator[np.ndarray]:
        far = np.diff(np.concatenate(([0], np.cumsum(texts.buf >= 0xCA)))[texts.off])
        for i in range(texts.n):
            raw = texts.bytes(i)
            if fast and not far[i] and not any(s in raw for s in special):
                yield np.array(fast.encode_ordinary(raw.decode()), np.uint32)
            else:
                yield np.array(whole.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)

    return of


def balance(lengths: np.ndarray, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal pieces to as many full sequences as their tokens fill.

    Returns (sequence, piece, from, to) in each sequence's order, and (piece, from, to) of what is over.
    """
    n = int(lengths.sum()) // size
    room = np.full(n, size, np.int64)
    cost = np.zeros(n)
    placed: list[tuple[int, int, int, int]] = []
    late: list[int] = []
    for p in np.argsort(-lengths, kind="stable").tolist():
        m = int(lengths[p])
        s = int(np.argmin(np.where(room >= m, cost, np.inf))) if n else 0
        if not n or room[s] < m:
            late.append(p)
            continue
        placed.append((s, p, 0, m))
        room[s] -= m
        cost[s] += linear * m + quadratic * m * m
    over: list[tuple[int, int, int]] = []
    for p in late:
        a, m = 0, int(lengths[p])
        while a < m:
            s = int(np.argmin(np.where(room > 0, cost, np.inf))) if n else 0
            if not n or not room[s]:
                over.append((p, a, m))
                break
            k = min(m - a, int(room[s]))
            placed.append((s, p, a, a + k))
            room[s] -= k
            cost[s] += linear * k + quadratic * k * k
            a += k
    placed.sort(key=lambda x: x[0])
    return placed, over


class Packer:
    """Packs a stream of documents; pieces come out as rows (document, start, length, sequence, offset, ids)."""

    def __init__(self, size: int, group: int, first: int):
        self.size, self.group, self.sequence = size, group, first
        self.rests: list[tuple[object, int, int, np.ndarray]] = []
        self.held = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        n, size = len(ids), self.size
        for a in range(0, n - size + 1, size):
            yield doc, n, a, size, self.sequence, 0, ids[a : a + size]
            self.sequence += 1
        if n % size:
            self.rests.append((doc, n, n - n % size, ids[n - n % size :]))
            self.held += n % size
            if self.held >= self.group:
                yield from self.flush(False)

    def flush(self, end: bool) -> Iterator[tuple]:
        placed, over = balance(np.array([len(r[3]) for r in self.rests], np.int64), self.size)
        last, at = -1, 0
        for s, p, a, b in placed:
            doc, n, start, ids = self.rests[p]
            at = 0 if s != last else at
            yield doc, n, start + a, b - a, self.sequence + s, at, ids[a:b]
            last, at = s, at + b - a
        self.sequence += last + 1
        rests = [(self.rests[p][0], self.rests[p][1], self.rests[p][2] + a, self.rests[p][3][a:b]) for p, a, b in over]
        self.held = sum(len(r[3]) for r in rests)
        if end:
            at, room = 0, 1 << (self.held.bit_length() - 1) if self.held else 0
            left = self.held
            for doc, n, start, ids in rests:
                while len(ids):
                    k = min(len(ids), room - at)
                    yield doc, n, start, k, self.sequence, at, ids[:k]
                    start, ids, at, left = start + k, ids[k:], at + k, left - k
                    if at == room:
                        self.sequence, at, room = self.sequence + 1, 0, 1 << (left.bit_length() - 1) if left else 0
            rests, self.held = [], 0
        self.rests = rests


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ids_crc32 is of the piece's ids as unsigned little-endian 32-bit numbers. Other columns of docs are dropped.
    """
    id_type = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary, ranks, pattern)
        packer = Packer(size, group_tokens, TaskContext.get().partitionId() << 32)
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc, n, start, length, sequence, at, ids = zip(*rows)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            columns = [pa.array(doc, kind), *(pa.array(x, pa.int64()) for x in (start, length, crc, n, sequence, at))]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        rows: list[tuple] = []
        for part, texts in blocks(batches, "text"):
            kind = part.column(0).type
            for doc, ids in zip(part.column(0).to_pylist(), of(texts)):
                rows += packer.add(doc, np.append(ids, np.uint32(END)))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows += packer.flush(True)
        if rows:
            yield batch(rows)

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, T.StructType(fields))
