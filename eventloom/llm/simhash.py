"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits by a binary trie self-join.

Fingerprints are made once, whole texts at a time, and written to the shared folder. Exact copies meet in a
pre-aggregated group by fingerprint. The 64 bits are cut into budget + 4 blocks: two linked fingerprints agree
on all but `budget` of these, so every choice of the agreeing blocks is a bucket key, and buckets share all bits
but at most 22. In each bucket the sorted fingerprints are a binary trie; pairs of its nodes are walked together
from the root, differing bits add up, and a pair is dropped once they exceed the budget. A fingerprint has at
most 253 partners within a bucket, whatever the bucket's size, and only a spanning star of each bucket's
components leaves the task. Stars from all buckets meet in rounds of large-star and small-star contraction,
each written to the shared folder.

Null and empty texts have fingerprint zero, and link like any other. Repeated rows are linked to each other. A
component's id is its smallest id that is not null; a component without any has a null id. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import Texts, free_name, map_batches, release_shuffles, with_columns
from eventloom.shared import discard, materialize

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [h(b" ".join(words), SEED)]
    elif shingle == 3:
        hashes = [h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    n = len(hashes)
    # Bits as bytes, summed eight at a time; a byte holds sums of up to 255 rows.
    lanes = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    if n % 255:
        lanes = np.concatenate([lanes, np.zeros((255 - n % 255, 8), np.uint64)])
    sums = lanes.reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint of each text, its 64 bits as a signed long."""

    def each():
        def of(texts: Texts) -> dict[str, pa.Array]:
            fp = np.array([fingerprint(texts.bytes(i), shingle) for i in range(texts.n)], np.uint64)
            return {name: pa.array(fp.view(np.int64))}

        return of

    return with_columns(docs, text, T.StructType([T.StructField(name, T.LongType())]), each)


def bucket_masks(budget: int) -> list[int]:
    """Masks of the agreeing blocks; linked fingerprints are equal under one of them at least."""
    parts = budget + 4
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in keep) for keep in combinations(range(parts), parts - budget)]


def trie_join(fp: np.ndarray, bucket: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in fp) of one bucket that differ in at most budget bits.

    fp is sorted within buckets, which stand together: each bucket is a binary trie whose nodes are runs of fp.
    A pair of nodes is (first and last of a run, first and last of a run, bits that differ so far).
    """
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    tails = np.concatenate((heads[1:], [len(fp)]))
    many = tails - heads > 1
    a0, a1 = heads[many], tails[many]
    b0, b1, d = a0, a1, np.zeros(len(a0), np.int64)
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am = a1 - (ones[a1] - ones[a0])  # where the run's ones begin
        bm = b1 - (ones[b1] - ones[b0])
        same = a0 == b0  # a node with itself: its two children cross once
        sides = (
            (a0, am, b0, bm, d, np.ones(len(d), bool)),
            (am, a1, bm, b1, d, np.ones(len(d), bool)),
            (a0, am, bm, b1, d + 1, np.ones(len(d), bool)),
            (am, a1, b0, bm, d + 1, ~same),
        )
        keep = [(x1 > x0) & (y1 > y0) & (e <= budget) & ok & ~((x0 == y0) & (x1 - x0 == 1)) for x0, x1, y0, y1, e, ok in sides]
        a0, a1, b0, b1, d = (np.concatenate([s[k][m] for s, m in zip(sides, keep)]) for k in range(5))
    return a0, b0


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, by hooking roots and halving paths."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        hi, lo = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[differ], b[differ]


def links(distinct: DataFrame, fp: str, budget: int) -> DataFrame:
    """Edges (u, v), u > v, that connect what is linked among distinct fingerprints."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(bucket_masks(budget))])
    dealt = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("k")).select("k.c", "k.key", "fp").repartition("c", "key").sortWithinPartitions("c", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def joined(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
            bucket = np.cumsum(new)
            size = np.bincount(bucket)
            some = size[bucket] > 1
            if not some.any():
                return
            fp, bucket = fp[some], bucket[some]
            order = np.lexsort((fp.view(np.uint64), bucket))
            fp, bucket = fp[order], bucket[order]
            a, b = trie_join(fp.view(np.uint64), bucket, budget)
            if len(a):
                root = forest(len(fp), a, b)
                at = np.flatnonzero(root != np.arange(len(fp)))
                x, y = fp[at], fp[root[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], schema=schema)

        held: list[np.ndarray] = []
        for batch in batches:
            c, key, fp = (batch.column(k).to_numpy() for k in range(3))
            if held:
                c, key, fp = (np.concatenate(x) for x in zip(held, (c, key, fp)))
            if not len(c):
                continue
            # The last bucket may go on in the next batch.
            cut = int(np.flatnonzero((key != key[-1]) | (c != c[-1]))[-1]) + 1 if ((key != key[-1]) | (c != c[-1])).any() else 0
            if cut:
                yield from joined(c[:cut], key[:cut], fp[:cut])
            held = [x[cut:].copy() for x in (c, key, fp)]
        if held and len(held[0]):
            yield from joined(*held)

    return map_batches(dealt, run, "u long, v long")


#: Edges of a node beyond which it counts as a hub; more, where else there could be more than 2 * MOST_HUBS of them. Keys that a hub's edges are dealt to.
MANY, MOST_HUBS, SALTS = 500, 10_000, 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that can be reached.

    Large-star and small-star in turn, until every edge hangs on a root. Each round is written to the shared
    folder; a node's edges are reduced to a minimum before they are joined back, and those of a hub are dealt out
    under many keys, so no node's edges meet in a task.
    """
    spark = edges.sparkSession
    e = materialize(edges.where("u > v").distinct(), "edges")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("low", "u").alias("m"), "n")
        # A node of very many edges is the hub of a star: its edges are dealt out under SALTS keys.
        many = max(MANY, e.count() // MOST_HUBS)
        salts = F.when(F.col("n") > many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        hubs = F.broadcast(least.where(F.col("n") > many).select("u", F.lit(SALTS).alias("salts")))  # at most 2 * MOST_HUBS
        ends = both.where("v > u").join(hubs, "u", "left").withColumn("salt", F.pmod(F.hash("v"), F.coalesce("salts", F.lit(1)))).drop("salts")
        large = ends.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        old, e = e, materialize(small.where("u > v").distinct(), "edges")
        discard(old)
        # Done when no root hangs on another, and no node has two roots.
        state = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_ = state.where("n > 1").select(F.lit(1).alias("x")).limit(1).unionAll(e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x")).limit(1))
        if not open_.take(1):
            release_shuffles(spark)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id) for each row of docs."""
    made = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle).select("doc_id", "fp"), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(made.select("fp").distinct(), "fp", budget))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(known.join(named, "root").select("fp", "component_id"), "components")
    return made.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies: wide fingerprints

#: Bits of a wide fingerprint, and how many of them two may differ in to be linked. Texts whose 5-word shingles have a
#: similarity of 0.8 differ in 39 on average, with a deviation of 6; texts that have nothing to do with each other in 128.
WIDE, WIDE_BUDGET = 256, 48
#: The similarity that is sought, and the share of such pairs that the buckets must bring together.
SIMILARITY, RECALL = 0.8, 0.95
#: Fingerprints that a bucket holds on average, beyond which its key takes one bit more.
BUCKET = 256
#: Rows of a bucket up to which pairs are walked; larger ones are explored from one member to the next. Buckets of more rows than HELD are crowded: see crowded_links.
WALKED, HELD = 512, 1 << 17
#: Rows that are joined at once.
STEP = 1 << 15


def wide_fingerprint(text: bytes, shingle: int = 5) -> np.ndarray:
    """The SimHash of a text's word shingles, repeats included, in WIDE bits; ties go by the least shingle's bit. Zero without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(WIDE // 64, np.uint64)
    grams = [b" ".join(words)] if len(words) <= shingle else [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = xxhash.xxh3_128_digest
    raw = np.frombuffer(b"".join([h(g, SEED) + h(g, SEED + 1) for g in grams]), np.uint8).reshape(len(grams), WIDE // 8)
    sums = np.zeros(WIDE, np.int64)
    for i in range(0, len(raw), 4096):
        sums += np.unpackbits(raw[i : i + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    least = np.unpackbits(raw[raw[:, :8].copy().view(np.uint64).ravel().argmin()], bitorder="little")
    return np.packbits((2 * sums > len(raw)) | ((2 * sums == len(raw)) & (least > 0)), bitorder="little").view(np.uint64)


def wide_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """docs with the words of each text's wide fingerprint, as its last columns."""
    fields = T.StructType([T.StructField(f"fp{k}", T.LongType()) for k in range(WIDE // 64)])

    def each():
        def of(texts: Texts) -> dict[str, pa.Array]:
            fp = np.array([wide_fingerprint(texts.bytes(i), shingle) for i in range(texts.n)], np.uint64).reshape(texts.n, WIDE // 64)
            return {f.name: pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k, f in enumerate(fields.fields)}

        return of

    return with_columns(docs, text, fields, each)


def tables_of(n: int) -> list[np.ndarray]:
    """Masks of the bits that each table's keys hold, for n fingerprints: so many bits that buckets stay small, so many
    tables that a pair of the similarity sought shares a key in one of them with probability RECALL."""
    bits = 16 + max(0, int(np.ceil(np.log2(max(n, 1) / BUCKET))) - 16)
    cosine = 2 * SIMILARITY / (1 + SIMILARITY)
    agree = (1 - np.arccos(cosine) / np.pi) ** bits
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(int(np.ceil(np.log(1 - RECALL) / np.log1p(-agree)))):
        held = np.zeros(WIDE, np.uint8)
        held[rng.permutation(WIDE)[:bits]] = 1
        out.append(np.packbits(held, bitorder="little").view(np.uint64))
    return out


def wide_trie_join(fp: np.ndarray, bucket: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket that differ in at most budget bits; rows are sorted within buckets, which stand together.

    Pairs of trie nodes are walked from the root as in trie_join, and dropped once their paths differ in too many
    bits; where both have come down to one leaf, the bits that are left are counted at once.
    """
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    tails = np.concatenate((heads[1:], [len(fp)]))
    many = tails - heads > 1
    a0, a1 = heads[many], tails[many]
    b0, b1, d = a0, a1, np.zeros(len(a0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for place in range(WIDE):
        word, bit = place // 64, np.uint64(63 - place % 64)
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            x, y = a0[leaves], b0[leaves]
            near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= budget
            found.append((x[near], y[near]))
            a0, a1, b0, b1, d = (v[~leaves] for v in (a0, a1, b0, b1, d))
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((fp[:, word] >> bit) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        sides = ((a0, am, b0, bm, d, True), (am, a1, bm, b1, d, True), (a0, am, bm, b1, d + 1, True), (am, a1, b0, bm, d + 1, ~same))
        keep = [(x1 > x0) & (y1 > y0) & (e <= budget) & ok & ~((x0 == y0) & (x1 - x0 == 1)) for x0, x1, y0, y1, e, ok in sides]
        a0, a1, b0, b1, d = (np.concatenate([v[k][m] for v, m in zip(sides, keep)]) for k in range(5))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def explore(fp: np.ndarray, budget: int) -> np.ndarray:
    """The first member of each row's component, by going from member to member; what has been reached is not looked at again.

    Rows within budget of a member are gone from at once: what is linked to one of them differs from the member in
    at most twice the budget, so they are compared with such rows only.
    """
    root = np.arange(len(fp))
    left, words = np.arange(len(fp)), np.ascontiguousarray(fp.T)

    def apart(words: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words ^ one[:, None]).sum(axis=0, dtype=np.uint16)

    while len(left):
        start, left, words = left[0], left[1:], words[:, 1:]
        open_ = [start]
        while open_ and len(left):
            d = apart(words, fp[open_.pop()])
            if d.min() > budget:
                continue
            reached = d <= budget
            near, about = np.flatnonzero(reached), np.flatnonzero(~reached & (d <= 2 * budget))
            if len(about) <= len(near):
                inside = words[:, near]
                hit = np.array([(apart(inside, fp[i]) <= budget).any() for i in left[about]], bool)
                new = about[hit]
            else:
                found, rest, outside = [np.zeros(0, np.int64)], about, words[:, about]
                for i in left[near]:
                    hit = apart(outside, fp[i]) <= budget
                    if hit.any():
                        found.append(rest[hit])
                        rest, outside = rest[~hit], outside[:, ~hit]
                new = np.concatenate(found)
            reached[new] = True
            root[left[reached]] = start
            open_ += left[new].tolist()
            left, words = left[~reached], np.ascontiguousarray(words[:, ~reached])
    return root


def as_nodes(fp: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, the highest first."""
    raw, size = fp.astype(">u8").tobytes(), WIDE // 8
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _pairs(x: list[bytes], y: list[bytes], *more: pa.Array) -> list[pa.Array]:
    return [pa.array([max(p) for p in zip(x, y)], pa.binary()), pa.array([min(p) for p in zip(x, y)], pa.binary()), *more]


def wide_links(distinct: DataFrame, names: list[str], budget: int = WIDE_BUDGET) -> DataFrame:
    """Edges (u, v) of nodes (fingerprints as bytes), u > v, that connect whatever shares a bucket and is linked.

    Buckets of up to HELD rows are joined in a task. Of larger ones the task joins HELD rows after HELD rows, and
    hands on all of them, with their key, to crowded_links.
    """
    signed = lambda m: int(m) - (1 << 64) if int(m) >> 63 else int(m)
    masks = tables_of(distinct.count())
    keys = F.array(*[F.xxhash64(F.lit(i), *(F.col(c).bitwiseAND(F.lit(signed(m)).cast("long")) for c, m in zip(names, mask))) for i, mask in enumerate(masks)])
    dealt = distinct.select(F.explode(keys).alias("key"), *names).repartition("key").sortWithinPartitions("key")
    held_at_once, step = HELD, STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("key", pa.int64())])

        def edges(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_pairs(as_nodes(x), as_nodes(y), pa.nulls(len(x), pa.int64())), schema=schema)

        def handed_on(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(as_nodes(fp), pa.binary()), pa.nulls(len(fp), pa.binary()), pa.array(key)], schema=schema)

        def joined(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            bucket = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
            size = np.bincount(bucket)[bucket]
            small = (size > 1) & (size <= WALKED)
            if small.any():
                f, b = fp[small], bucket[small]
                order = np.lexsort((*(f[:, k] for k in range(f.shape[1] - 1, -1, -1)), b))
                f, b = f[order], b[order]
                x, y = wide_trie_join(f, b, budget)
                if len(x):
                    root = forest(len(f), x, y)
                    at = np.flatnonzero(root != np.arange(len(f)))
                    yield edges(f[at], f[root[at]])
            for k in np.unique(bucket[size > WALKED]).tolist():
                f = fp[bucket == k]
                root = explore(f, budget)
                at = np.flatnonzero(root != np.arange(len(f)))
                if len(at):
                    yield edges(f[at], f[root[at]])

        key, fp = np.zeros(0, np.int64), np.zeros((0, WIDE // 64), np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        crowded = None  # the key of a bucket whose first rows have been handed on
        for batch in batches:
            held.append((batch.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1)))
            if sum(len(k) for k, _ in held) < step:
                continue
            key, fp = (np.concatenate(x) for x in zip((key, fp), *held))
            held = []
            cut = int(np.argmax(key == key[-1]))  # the last bucket may go on
            if cut:
                if key[0] == crowded:
                    yield handed_on(key[key == crowded], fp[key == crowded])
                yield from joined(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if len(key) > held_at_once:
                crowded = key[0]
                yield handed_on(key, fp)
                yield from joined(key, fp)
                key, fp = key[:0], fp[:0]
        key, fp = (np.concatenate(x) for x in zip((key, fp), *held))
        if len(key):
            if key[0] == crowded:
                yield handed_on(key[key == crowded], fp[key == crowded])
            yield from joined(key, fp)

    found = materialize(map_batches(dealt, run, "u binary, v binary, key long"), "links")
    known, crowd = found.where("key is null").select("u", "v"), found.where("key is not null").select("key", F.col("u").alias("node"))
    return crowded_links(known, crowd, budget, held_at_once) if crowd.take(1) else known


def crowded_links(known: DataFrame, crowd: DataFrame, budget: int, held: int) -> DataFrame:
    """known, edges (u, v), and edges that connect whatever is linked in crowded buckets, rows (key, node) of one key each.

    Every two rows of a bucket are compared, unless known connects them already. A component with more than held rows
    in a bucket is dealt into parts of its own, and all other rows are dealt into mixed parts, of about held rows each.
    Parts meet two by two, each meeting a task's work, but not two of one component. So a group of near copies, however
    large, meets only what it is not connected with; work is quadratic in rows that nothing connects.
    """
    roots = components(known)
    labelled = crowd.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    labelled = materialize(labelled, "crowd")
    mixed = F.lit(b"")
    sizes = labelled.groupBy("key", "root").count().select("key", F.when(F.col("count") > held, F.col("root")).otherwise(mixed).alias("of"), "count")
    sizes = sizes.groupBy("key", "of").agg(F.ceil(F.sum("count") / held).cast("int").alias("parts"))
    sizes = materialize(sizes, "sizes")
    # At most two rows for held rows of the crowd: one for each large component, one for each key.
    own = F.broadcast(sizes.where(F.col("of") != mixed).select("key", F.col("of").alias("root"), F.col("parts").alias("own")))
    shared = F.broadcast(sizes.where(F.col("of") == mixed).select("key", F.col("parts").alias("shared")))
    place = F.pmod(F.xxhash64("node"), F.coalesce("own", "shared").cast("long")).cast("int")
    rows = labelled.join(own, ["key", "root"], "left").join(shared, "key", "left").select("key", F.when(F.col("own").isNotNull(), F.col("root")).otherwise(mixed).alias("of"), place.alias("part"), "node", "root")
    parts = sizes.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "of")
    a, b = (parts.select("key", F.col("of").alias(f"of_{x}"), F.col("part").alias(f"part_{x}")) for x in "ab")
    meet = (F.col("of_a") < F.col("of_b")) | ((F.col("of_a") == mixed) & (F.col("of_b") == mixed) & (F.col("part_a") < F.col("part_b")))
    meetings = materialize(a.join(b, "key").where(meet).withColumn("meeting", F.monotonically_increasing_id()), "meetings")
    sides = [meetings.select("key", F.col(f"of_{x}").alias("of"), F.col(f"part_{x}").alias("part"), "meeting") for x in "ab"]
    n = meetings.count()
    dealt = rows.join(sides[0].unionAll(sides[1]), ["key", "of", "part"]).select("meeting", "node", "root").repartition(min(max(n, 1), 10_000), "meeting").sortWithinPartitions("meeting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

        def joined(nodes: list[bytes], roots: list[bytes]) -> Iterator[pa.RecordBatch]:
            fp = np.frombuffer(b"".join(nodes), ">u8").astype(np.uint64).reshape(len(nodes), WIDE // 64)
            first = explore(fp, budget).tolist()
            new = sorted({(r, roots[i]) for r, i in zip(roots, first) if r != roots[i]})
            if new:
                yield pa.RecordBatch.from_arrays(_pairs(*map(list, zip(*new))), schema=schema)

        now, nodes, roots = None, [], []
        for batch in batches:
            meeting = batch.column(0).to_numpy()
            heads = [0, *(np.flatnonzero(meeting[1:] != meeting[:-1]) + 1).tolist(), len(meeting)]
            for i, j in zip(heads, heads[1:]):
                if i == j:
                    continue
                if meeting[i] != now:
                    if nodes:
                        yield from joined(nodes, roots)
                    now, nodes, roots = meeting[i], [], []
                part = batch.slice(i, j - i)
                nodes += part.column(1).to_pylist()
                roots += part.column(2).to_pylist()
        if nodes:
            yield from joined(nodes, roots)

    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(map_batches(dealt, run, "u binary, v binary"))


def keep_one_of_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, budget: int = WIDE_BUDGET) -> DataFrame:
    """One row of docs of each group of texts whose word shingles have a similarity of 0.8 or more, directly or through others.

    Similarity is judged by wide fingerprints; see WIDE. Which row stays, and what null ids and empty texts give, is as
    in keep_one. At a similarity of 0.8 exactly about nine pairs of ten are found, at 0.9 and more nearly all; pairs of
    0.7 are linked about as often as not, of 0.5 and less hardly ever.
    """
    row, code, node = free_name(docs, "row"), free_name(docs, "code"), free_name(docs, "node")
    made = wide_fingerprints(docs, text, shingle)
    names = made.columns[len(docs.columns) :]
    made = materialize(made.withColumn(row, F.monotonically_increasing_id()).withColumn(code, F.xxhash64(text)), "fingerprints")
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(code).alias("code"), F.col(row).alias("row"))
    least = made.groupBy(*names).agg(F.min(place).alias("least"))
    roots = components(wide_links(made.select(*names).distinct(), names, budget))
    whole = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in names)))
    kept = least.select(whole.alias(node), "least").join(roots.withColumnRenamed("node", node), node, "left").groupBy(F.coalesce("root", node).alias("root")).agg(F.min("least").alias("least"))
    return made.join(kept.select(F.col("least.row").alias(row)), row, "left_semi").select(*docs.columns)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 2, shingle: int = 3) -> DataFrame:
    """One row of docs of each component: that with the smallest id, null being the last; of several, that whose text hashes least.

    Rows have keys of their own, written with the fingerprints, so rows without an id, or with one id, are told apart.
    """
    fp, row, code = free_name(docs, "fp"), free_name(docs, "row"), free_name(docs, "code")
    made = fingerprints(docs, text, shingle, fp).withColumn(row, F.monotonically_increasing_id()).withColumn(code, F.xxhash64(text))
    made = materialize(made, "fingerprints")
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(code).alias("code"), F.col(row).alias("row"))
    # The least of each fingerprint, then of each component: rows are combined before they are shuffled.
    least = made.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("least"))
    roots = components(links(made.select(F.col(fp).alias("fp")).distinct(), "fp", budget)).withColumnRenamed("node", "fp")
    kept = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    return made.join(kept, row, "left_semi").select(*docs.columns)
