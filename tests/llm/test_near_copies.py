"""Wide fingerprints against all pairs, and near copies that are made to go."""

from __future__ import annotations

import random

import numpy as np

from eventloom.llm import simhash


def some_fingerprints(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints around a few centres, in buckets."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 120))
    fp = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)[rng.integers(0, 6, n)]
    for i in range(n):
        for k in rng.integers(0, 256, rng.integers(0, 50)):
            fp[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    fp = np.unique(fp, axis=0)
    bucket = np.sort(rng.integers(0, 3, len(fp)))
    order = np.lexsort((fp[:, 3], fp[:, 2], fp[:, 1], fp[:, 0], bucket))
    return fp[order], bucket[order]


def apart(fp: np.ndarray, i: int, j: int) -> int:
    return int(np.bitwise_count(fp[i] ^ fp[j]).sum())


def test_wide_trie_join_against_all_pairs():
    for seed in range(30):
        fp, bucket = some_fingerprints(seed)
        x, y = simhash.wide_trie_join(fp, bucket, 48)
        want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bucket[i] == bucket[j] and apart(fp, i, j) <= 48}
        got = [tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_exploring_gives_the_same_components():
    for seed in range(30):
        fp, _ = some_fingerprints(seed)
        x, y = simhash.wide_trie_join(fp, np.zeros(len(fp), int), 48)
        assert (simhash.explore(fp, 48) == simhash.forest(len(fp), x, y)).all()


def test_tables_grow_with_the_fingerprints():
    assert [len(simhash.tables_of(n)) for n in (0, 10, 1 << 24)] == [40, 40, 40] and len(simhash.tables_of(1 << 30)) > 100
    assert all(int(np.bitwise_count(m).sum()) == 22 for m in simhash.tables_of(1 << 30))


def test_near_copies_go(spark):
    """Of a text, copies of similarity 0.85 and 0.92, a large group of copies, and texts that share half: which stay."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]

    def changed(words: list[str], n: int) -> list[str]:
        out = list(words)
        for k in range(n):  # spread, so that each takes five shingles
            out[3 + k * (len(out) // n)] = word()
        return out

    rows, clean, copies = [], set(), set()
    for i in range(60):
        base = text(200)
        rows.append((10 * i, " ".join(base)))
        clean.add(10 * i)
        for k, n in ((1, 3), (2, 2), (3, 0)):  # similarities of about 0.86, 0.9 and 1
            rows.append((10 * i + k, " ".join(changed(base, n)).upper() if k == 2 else "  ".join(changed(base, n))))
            copies.add(10 * i + k)
        rows.append((10 * i + 5, " ".join(base[:100] + text(100))))  # half of it: about 0.33
        clean.add(10 * i + 5)
    big = text(150)
    rows += [(1000 + i, " ".join(changed(big, 1))) for i in range(1200)]
    rows += [(5000, ""), (5001, None), (5002, " \n"), (None, "alone and without an id"), (5003, "one"), (5004, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = simhash.keep_one_of_similar(df)
    assert kept.columns == df.columns
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids)) and clean <= set(ids) and {1000, 5000, 5003, 5004, None} <= set(ids)
    assert len(copies & set(ids)) <= 4 and len([i for i in ids if i and 1000 <= i < 5000]) == 1 and not {5001, 5002} & set(ids)
    assert simhash.keep_one_of_similar(df.limit(0)).count() == 0


def test_components_of_hubs_chains_and_rings(spark):
    """Stars with more edges than a hub may have, chains, and random graphs, against union and find."""
    r = random.Random(1)
    graphs = (
        [(5000, i) for i in range(2000)] + [(9000 + i, 7 * i) for i in range(300)] + [(9000 + i, 9001 + i) for i in range(0, 300, 3)],
        [(i, i + 1) for i in range(150)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(300)],
    )
    for edges in graphs:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            root.setdefault(i, i)
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        df = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "u long, v long")
        got = {x.node: x.root for x in simhash.components(df).collect()}
        assert {k: v for k, v in got.items() if k != v} == {i: find(i) for i in root if find(i) != i}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """One bucket of many more rows than a task holds, against all pairs: a large group with rows that hang on single members of it, two more groups, chains, and rows that hang on nothing."""
    monkeypatch.setattr(simhash, "HELD", 300)
    monkeypatch.setattr(simhash, "STEP", 100)
    monkeypatch.setattr(simhash, "tables_of", lambda n: [np.array([0xFFFF, 0, 0, 0], np.uint64)])
    rng = np.random.default_rng(7)

    def flipped(fp: np.ndarray, n: int) -> np.ndarray:
        out = fp.copy()
        for k in rng.permutation(240)[:n] + 16:  # none of the bucket's bits
            out[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
        return out

    def base() -> np.ndarray:
        out = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        out[0] &= np.uint64(0xFFFFFFFFFFFF0000)
        return out

    rows = []
    for members, hanging in ((900, 250), (350, 40), (200, 40)):
        centre = base()
        group = [flipped(centre, 20) for _ in range(members)]
        rows += group + [flipped(m, 44) for m in group[:: members // hanging]]
    for _ in range(30):  # each link of a chain is one in all
        row = base()
        for _ in range(6):
            rows.append(row)
            row = flipped(row, 45)
    rows += [base() for _ in range(300)]
    fp = np.unique(np.array(rows), axis=0)
    x, y = (np.concatenate(v) for v in zip(*[(np.full(len(j), i), j) for i in range(len(fp)) for j in [i + 1 + np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]).sum(axis=1) <= 48)]]))
    root = simhash.forest(len(fp), x, y)
    node = [b.astype(">u8").tobytes() for b in fp]
    want = {node[i]: node[r] for i, r in enumerate(root.tolist()) if i != r}

    shuffled = fp[rng.permutation(len(fp))].view(np.int64).tolist()
    df = spark.createDataFrame(shuffled, "a long, b long, c long, d long").repartition(5)
    edges = simhash.wide_links(df, df.columns)
    got = {bytes(r.node): bytes(r.root) for r in simhash.components(edges).collect()}
    assert len(set(root.tolist())) > 300 and {k: v for k, v in got.items() if k != v} == want
