"""Self- and mutually-exciting point processes: parent pairs, posteriors, shares, exposure, and fits.

Intensity of type i at t: mu_i + sum over earlier events l within L of sum_m alpha[i, type l, m] beta_m exp(-beta_m (t - t_l)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.operators import pointfit


def pairs(events: DataFrame, by: str, event_id: str, t: str, kind: str, reach: float) -> DataFrame:
    """(by, target, source, i, j, dt): earlier events of the same realization within reach; ties are no pairs.

    Times are cut into slots as long as the reach, so each event meets those of its own slot and the one before.
    """
    c = events.select(F.col(by).alias("by"), F.col(event_id).alias("target"), F.col(t).alias("tt"), F.col(kind).alias("i"))
    c = c.withColumn("slot", F.explode(F.array(F.floor(F.col("tt") / reach), F.floor(F.col("tt") / reach) - 1)))
    p = events.select(F.col(by).alias("by"), F.col(event_id).alias("source"), F.col(t).alias("ts"), F.col(kind).alias("j")).withColumn("slot", F.floor(F.col("ts") / reach))
    dt = F.col("tt") - F.col("ts")
    return c.join(p, ["by", "slot"]).where((dt > 0) & (dt <= reach)).select(F.col("by").alias(by), "target", "source", "i", "j", dt.alias("dt"))


def kernel(dt: Column, betas: list[float], weights: list[float]) -> Column:
    return sum((F.lit(w * b) * F.exp(-b * dt) for b, w in zip(betas, weights)), F.lit(0.0))


def posterior(pair: DataFrame, events: DataFrame, event_id: str, alpha: Column, mu: Column, betas: list[float], weights: list[float], min_prob: float = 0.01) -> DataFrame:
    """(target, source, i, j, prob): how likely each earlier event, or none (source null), gave rise to a target."""
    v = pair.select("target", "source", "i", "j", (alpha * kernel(F.col("dt"), betas, weights)).alias("v"))
    base = events.select(F.col(event_id).alias("target"), F.lit(None).cast("long").alias("source"), F.col("i"), F.lit(None).cast(pair.schema["j"].dataType).alias("j"), mu.alias("v"))
    prob = F.col("v") / F.sum("v").over(W.partitionBy("target"))
    return v.unionByName(base).withColumn("prob", prob).where(F.col("prob") >= min_prob).drop("v")


def shares(post: DataFrame) -> DataFrame:
    """Mass of parents by class: none, self, other."""
    name = F.when(F.col("source").isNull(), "base").when(F.col("i") == F.col("j"), "self").otherwise("other")
    return post.groupBy("i", name.alias("parent")).agg(F.sum("prob").alias("mass"))


def exposure(events: DataFrame, by: str, t: str, kind: str, length: Column, betas: list[float], reach: float) -> DataFrame:
    """Of each type as a source, the kernel mass that falls inside its realizations, for each time scale."""
    rest = F.least(F.lit(reach), length - F.col(t))
    return events.groupBy(F.col(kind).alias("j")).agg(*(F.sum(1 - F.exp(-b * rest)).alias(f"g{m}") for m, b in enumerate(betas)))


def fit_em(t: np.ndarray, kind: np.ndarray, n_kinds: int, length: float, betas: np.ndarray, reach: float, tol: float = 1e-7, most: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(mu, alpha[i, j, m], log-likelihood) of one realization; see pointfit."""
    f = pointfit.fit(pointfit.design(t, kind, n_kinds, length, betas, reach), tol=tol, most=most)
    return f.mu, f.alpha, f.loglik


def fit_windows(events: DataFrame, by: str, t: str, kind: str, n_kinds: int, length: float, betas: list[float], reach: float) -> DataFrame:
    """A fit for each realization: its log-likelihood, spectral radius and base rates. One realization is one task."""
    b = np.array(betas)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, alpha, ll = fit_em(pdf["t"].to_numpy(float), pdf["k"].to_numpy(int), n_kinds, length, b, reach)
        n = (alpha * (1 - np.exp(-b * reach))).sum(axis=2)
        return pd.DataFrame({"by": [pdf["by"].iloc[0]], "n": [len(pdf)], "loglik": [ll], "rho": [float(np.abs(np.linalg.eigvals(n)).max())], "mu": [mu.tolist()]})

    rows = events.select(F.col(by).cast("long").alias("by"), F.col(t).cast("double").alias("t"), F.col(kind).cast("int").alias("k"))
    # Fits are long for their rows, so they are dealt out whatever their bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(4 * parts, "by").groupBy("by").applyInPandas(run, "by long, n long, loglik double, rho double, mu array<double>")


def simulate(rng: np.random.Generator, mu: np.ndarray, n: np.ndarray, beta: float, length: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, kind, parent) of one realization, generation by generation; n[i, j] is the mean number of i that a j gives rise to.

    n must have a spectral radius below 1, else it raises: such a realization may have no end.
    """
    if np.abs(np.linalg.eigvals(n)).max() >= 1:
        raise ValueError("the process explodes: its branching matrix has a spectral radius of 1 or more")
    t, kind, parent = [], [], []
    for k, m in enumerate(mu):
        c = rng.poisson(m * length)
        t += rng.uniform(0, length, c).tolist()
        kind += [k] * c
        parent += [-1] * c
    at = 0
    while at < len(t):
        for k in range(len(mu)):
            for dt in rng.exponential(1 / beta, rng.poisson(n[k, kind[at]])).tolist():
                if t[at] + dt < length:
                    t.append(t[at] + dt)
                    kind.append(k)
                    parent.append(at)
        at += 1
    return np.array(t), np.array(kind, int), np.array(parent, int)


def ks_exponential(gaps: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of gaps from the unit exponential, and its p-value by the limit's series."""
    x = np.sort(1 - np.exp(-gaps))
    n = len(x)
    if not n:
        return 0.0, 1.0
    i = np.arange(1, n + 1)
    d = float(max((i / n - x).max(), (x - (i - 1) / n).max()))
    z = (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * d
    k = np.arange(1, 101)
    return d, float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * z * z)).sum())))
