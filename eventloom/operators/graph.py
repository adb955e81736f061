"""Dependency graphs: last-writer edges, layers, statistics, forests of parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.shared import discard, materialize


def last_writer_edges(touches: DataFrame, key: str, who: str, t: str, first: bool = False, parts: int | None = None, times: bool = False) -> DataFrame:
    """(who, parent, key): for each first touch of a key, the latest other toucher that came strictly earlier.

    touches: a row for each (key, who), with the time of the first touch; first says that there is one already, else
    the earliest counts. parts: into how many the rows are dealt, where what an exchange weighs would make tasks too
    large. times: with t and before, when the two touched.
    """
    f = touches.select(F.col(key).alias("key"), F.col(who).alias("who"), F.col(t).alias("t")).where("t IS NOT NULL")
    f = f if first else f.groupBy("key", "who").agg(F.min("t").alias("t"))
    deal = lambda df, *by: df.repartition(parts, *by) if parts else df
    # One exchange by key and time serves both sides. All with one time meet the same past: the latest of the time before, of several the greatest.
    f = deal(f, "key", "t")
    at = f.groupBy("key", "t").agg(F.max("who").alias("last"))
    w = W.partitionBy("key").orderBy("t")
    past = deal(at, "key").select("key", "t", F.lag("last").over(w).alias("parent"), *([F.lag("t").over(w).alias("before")] if times else []))
    got = f.join(deal(past, "key", "t"), ["key", "t"]).where(F.col("parent").isNotNull())
    return got.select("who", "parent", "key", *(["t", "before"] if times else []))


#: Edges that one task may hold, 16 bytes each and as much again for its work; beyond, layers() goes by blocks of time, or rounds.
SMALL = 1 << 21


def longest_paths(child: np.ndarray, parent: np.ndarray, begun: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, layer): nodes leave once all their parents have left; a node's layer is one more than the last of theirs.

    begun: nodes, and layers that they have at least by edges which are not here; a node may come several times.
    """
    more, least = begun or (np.empty(0, np.int64), np.empty(0, np.int64))
    nodes, ends = np.unique(np.concatenate([child, parent, more]), return_inverse=True)
    c, p, m = np.split(ends, [len(child), 2 * len(child)])
    order = np.argsort(p, kind="stable")
    c, p = c[order], p[order]
    first = np.searchsorted(p, np.arange(len(nodes) + 1))
    waits = np.bincount(c, minlength=len(nodes))
    layer = np.zeros(len(nodes), np.int64)
    np.maximum.at(layer, m, least)
    now, left = np.flatnonzero(waits == 0), len(nodes)
    while len(now):
        left -= len(now)
        size = first[now + 1] - first[now]
        ends_ = np.cumsum(size)
        to = c[np.arange(ends_[-1]) + np.repeat(first[now] - (ends_ - size), size)]
        np.maximum.at(layer, to, np.repeat(layer[now] + 1, size))
        np.subtract.at(waits, to, 1)
        now = np.unique(to[waits[to] == 0])
    if left:
        raise ValueError("the edges have a cycle")
    return nodes, layer


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, layer) of rows (c, p, least): an edge, or, where least is not 0, what c has at least; p is then c itself."""
    c, p, n, m = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for pdf in batches:
        x, y, least = (pdf[k].to_numpy(np.int64) for k in ("c", "p", "least"))
        edge = least == 0
        c.append(x[edge])
        p.append(y[edge])
        n.append(x[~edge])
        m.append(least[~edge])
    nodes, layer = longest_paths(np.concatenate(c), np.concatenate(p), (np.concatenate(n), np.concatenate(m)))
    yield pd.DataFrame({"node": nodes, "layer": layer})


def _layers_in_time(e: DataFrame, n: int, small: int) -> DataFrame:
    """layers() of n edges (c, p, tc, tp) where each parent is earlier than its child.

    Time is cut into blocks, which go one after the other. A task has the edges inside a block, at most `small` of
    them, and what nodes have by edges from before, at most four times as many. What a block adds to later ones is
    joined and combined by all. As edges inside a block are fewer the shorter it is, blocks are about as many as the
    root of the edges. A single time has no edges inside, so it always is a block's work.
    """
    slots = max(64, min(1 << 12, 16 * n // max(1, small)))
    share = [k / slots for k in range(1, slots)]
    cuts = np.unique(np.array(e.approxQuantile("tc", share, 1 / (4 * slots)), float))
    two = "c long, p long, sc int, sp int"

    def slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at = {s: np.searchsorted(cuts, x[t].to_numpy(float), side="right").astype(np.int32) for s, t in (("sc", "tc"), ("sp", "tp"))}
            yield pd.DataFrame({"c": x["c"], "p": x["p"], **at})

    cut = materialize(e.mapInPandas(slot, two), "slots")
    held = np.zeros((len(cuts) + 1, len(cuts) + 1), np.int64)
    for r in cut.groupBy("sc", "sp").count().collect():  # slots squared, at most
        held[r[0], r[1]] = r[2]
    block, begin, inside, into = np.zeros(len(cuts) + 1, int), 0, 0, 0
    for k in range(len(cuts) + 1):
        inside, into = inside + held[k, begin : k + 1].sum(), into + held[k].sum()
        if k > begin and (inside > small or into > 4 * small):
            begin, inside, into = k, held[k, k], held[k].sum()
        block[k] = begin
    blocks = sorted(set(block.tolist()))
    name = F.lit(block.tolist()).cast("array<int>")
    cut = cut.select("c", "p", F.element_at(name, F.col("sc") + 1).alias("bc"), F.element_at(name, F.col("sp") + 1).alias("bp"))
    parts = max(1, n // (1 << 20))
    rows = materialize(cut.repartitionByRange(parts, "bp", "bc"), "blocks", by=["bp"])
    done, pushed = [], []
    for b in blocks:
        here = rows.where(F.col("bp") == b)
        work = here.where(F.col("bc") == b).select("c", "p", F.lit(0).cast("long").alias("least"))
        for m in pushed:
            work = work.unionByName(m.where(F.col("bc") == b).select("c", F.col("c").alias("p"), "least"))
        # Of a root, which has layer 0, no row is kept.
        got = materialize(work.coalesce(1).mapInPandas(_paths, "node long, layer long").where("layer > 0"), "layers")
        done.append(got)
        if b != blocks[-1]:
            on = here.where(F.col("bc") > b).join(got.select(F.col("node").alias("p"), "layer"), "p", "left")
            pushed.append(materialize(on.groupBy("bc", "c").agg((F.coalesce(F.max("layer"), F.lit(0)) + 1).alias("least")), "pushed", by=["bc"]))
    roots = cut.select(F.col("p").alias("node")).distinct().join(cut.select(F.col("c").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0).cast("long"))
    for got in done:
        roots = roots.unionByName(got)
    return roots


def layers(edges: DataFrame, child: str, parent: str, small: int = SMALL, times: tuple[str, str] | None = None) -> DataFrame:
    """(node, layer): the longest path from a node without parents. Edges (of whole numbers) must have no cycles, else it raises.

    Up to `small` edges are one task's work. More go by blocks of time, where times names the columns with a child's
    and its parent's time (numbers; a node has one time, and a parent's that is not less than its child's raises).
    Without times they go by rounds, as many as the longest path: the nodes that a walk of k edges from a root can end
    at; a node's layer is the last round that has it. Blocks and rounds are written to the shared folder, so the plan
    does not grow with the depth.
    """
    at = [F.col(t).cast("long").alias(n) for t, n in zip(times or (), ("tc", "tp"))]
    e = materialize(edges.select(F.col(child).cast("long").alias("c"), F.col(parent).cast("long").alias("p"), *at).distinct(), "edges")
    n = e.count()
    if n <= small:
        return e.select("c", "p", F.lit(0).cast("long").alias("least")).coalesce(1).mapInPandas(_paths, "node long, layer long")
    if times:
        if e.where("tp >= tc OR tp IS NULL OR tc IS NULL").take(1):
            raise ValueError("a parent is not earlier than its child")
        return _layers_in_time(e, n, small)
    at = e.select(F.col("p").alias("node")).distinct().join(e.select(F.col("c").alias("node")), "node", "left_anti")
    rounds = [materialize(at.withColumn("layer", F.lit(0).cast("long")), "layer")]
    n = e.select("c").distinct().count()
    while rounds[-1].take(1):
        if len(rounds) > n + 1:
            raise ValueError("the edges have a cycle")
        fresh = e.join(rounds[-1].select(F.col("node").alias("p")), "p", "left_semi").select(F.col("c").alias("node")).distinct()
        rounds.append(materialize(fresh.withColumn("layer", F.lit(len(rounds)).cast("long")), "layer"))
    all_ = rounds[0]
    for r in rounds[1:]:
        all_ = all_.unionByName(r)
    return all_.groupBy("node").agg(F.max("layer").alias("layer"))


def ancestors(parents: DataFrame, node: str, parent: str, start: DataFrame) -> DataFrame:
    """(node): those of start (node) and all above them in a forest given by parents.

    Each round doubles how far up the marked nodes see, so rounds are the logarithm of the depth. Joins
    are by exchange, so no round sends a table to the driver.
    """
    up = materialize(parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")), "up")
    marked = materialize(start.select("node").distinct(), "marked")
    while True:
        more = materialize(marked.hint("merge").join(up.hint("merge"), "node").select(F.col("up").alias("node")).distinct().join(marked.hint("merge"), "node", "left_anti"), "marked")
        if not more.take(1):
            return marked
        old = marked, more, up
        marked = materialize(marked.unionByName(more), "marked")
        up = materialize(up.hint("merge").join(up.select(F.col("node").alias("up"), F.col("up").alias("far")).hint("merge"), "up").select("node", F.col("far").alias("up")), "up")
        for table in old:
            discard(table)


def degrees(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Of the graph: edges, nodes with parents, the share of these with several, and the mean number of parents."""
    n = edges.select(child, parent).distinct().groupBy(child).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_edges"), F.count("*").alias("n_children"), F.avg((F.col("n") > 1).cast("double")).alias("multi_share"), F.avg("n").alias("mean_parents"))


def forest(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, generation) of a forest given by parents; roots have a null parent.

    Pointer jumping: each round doubles how far a node sees, so rounds are the logarithm of the depth. Only nodes with
    a parent take part; those that see a root are not joined again. Joins are by exchange, whatever the files' size,
    for rounds would send a table to the driver each.
    """
    rows = parents.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    roots = rows.where("up IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("generation"))
    at = materialize(rows.where("up IS NOT NULL").select("node", "up", F.lit(1).cast("long").alias("d"), F.lit(False).alias("done")), "forest")
    while at.where("NOT done").take(1):
        # What has no row here is a root.
        ahead = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        seen = at.where("NOT done").join(ahead.hint("merge"), "up", "left")
        seen = seen.select("node", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.coalesce("done2", F.lit(True)).alias("done"))
        nxt = materialize(at.where("done").unionByName(seen), "forest")
        discard(at)
        at = nxt
    return roots.unionByName(at.select("node", F.col("up").alias("root"), F.col("d").alias("generation")))
