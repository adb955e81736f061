"""Simulated teams on task graphs: a generator of graphs, and agents that work through them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def grow(rng: np.random.Generator, n_steps: int, n_layers: int, merge: float) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """(parents of each step, layers, durations): sizes rise along the layers; a step may merge two of the layer before."""
    share = 1 / (1 + np.exp(-np.linspace(-2, 2, n_layers))) * rng.uniform(0.7, 1.3, n_layers)
    sizes = np.maximum(1, np.round(n_steps * share / share.sum())).astype(int)
    layer = np.repeat(np.arange(n_layers), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    parents: list[list[int]] = []
    for k in layer:
        if not k:
            parents.append([])
            continue
        up = np.arange(first[k - 1], first[k])
        take = 2 if len(up) > 1 and rng.random() < merge else 1
        parents.append(sorted(rng.choice(up, take, replace=False).tolist()))
    return parents, layer, rng.lognormal(0, 0.5, len(layer))


def work(parents: list[list[int]], layer: np.ndarray, time: np.ndarray, n_agents: int, overhead: float = 0.05, talk: float = 0.01) -> tuple[float, float]:
    """(makespan, busy time) of n agents that take the deepest ready step first; a start costs overhead, each further agent some talk."""
    factor = 1 + overhead + (talk * (n_agents - 1) if n_agents > 1 else 0.0)
    left = [len(p) for p in parents]
    children: list[list[int]] = [[] for _ in parents]
    for c, ps in enumerate(parents):
        for p in ps:
            children[p].append(c)
    ready = [(-int(layer[i]), i) for i, n in enumerate(left) if not n]
    heapq.heapify(ready)
    running: list[tuple[float, int]] = []
    now = busy = 0.0
    while ready or running:
        while ready and len(running) < n_agents:
            _, i = heapq.heappop(ready)
            heapq.heappush(running, (now + float(time[i]) * factor, i))
            busy += float(time[i]) * factor
        now, i = heapq.heappop(running)
        for c in children[i]:
            left[c] -= 1
            if not left[c]:
                heapq.heappush(ready, (-int(layer[c]), c))
    return now, busy


def runs(spark: SparkSession, reps: int, team_sizes: list[int], seed: int = 3, n_steps: int = 120, n_layers: int = 8, merge: float = 0.3) -> DataFrame:
    """(rep, n_agents, makespan, busy, speedup): a graph for each replicate, worked by teams of each size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep in pdf["id"]:
                parents, layer, time = grow(np.random.default_rng([seed, int(rep)]), n_steps, n_layers, merge)
                alone = work(parents, layer, time, 1)[0]
                for n in team_sizes:
                    span, busy = work(parents, layer, time, n)
                    rows.append((int(rep), n, span, busy, alone / span))
            yield pd.DataFrame(rows, columns=["rep", "n_agents", "makespan", "busy", "speedup"])

    return spark.range(reps).mapInPandas(run, "rep long, n_agents int, makespan double, busy double, speedup double")
