"""Change points: noise scale, PELT, Bayesian online detection, and alignment tests by shifts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def noise_scale(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    """MAD of first differences over 0.67449 and the root of two; their standard deviation over that root if the MAD is 0."""
    w = W.partitionBy(*by).orderBy(order)
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(w)).where(F.col("_d").isNotNull())
    mid = d.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("_m"), F.stddev_pop("_d").alias("_sd"))
    mad = d.join(mid, by).groupBy(*by).agg(F.percentile(F.abs(F.col("_d") - F.col("_m")), F.lit(0.5)).alias("_mad"), F.first("_sd").alias("_sd"))
    return mad.select(*by, F.when(F.col("_mad") > 0, F.col("_mad") / 0.67449 / math.sqrt(2)).otherwise(F.col("_sd") / math.sqrt(2)).alias("sigma"))


def pelt(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """Starts of the segments but the first, for squared error from segment means and a penalty for each change."""
    n = len(x)
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, int)
    starts = np.array([0])
    # A start that is no better than a segment's end, even without the penalty, is of no use to segments that
    # could also begin at that end: those that end `least` later, or after.
    until = np.full(n + 1, n + least + 1)
    for e in range(least, n + 1):
        starts = starts[until[starts] > e]
        cost = best[starts] + (q[e] - q[starts]) - (s[e] - s[starts]) ** 2 / (e - starts)
        k = int(np.argmin(cost))
        best[e], back[e] = cost[k] + penalty, starts[k]
        worse = starts[cost > best[e]]
        until[worse] = np.minimum(until[worse], e + least)
        starts = np.append(starts, e - least + 1)
    out, e = [], n
    while e > 0 and back[e] > 0:
        e = int(back[e])
        out.append(e)
    return out[::-1]


def segment_optimal(x: np.ndarray, penalty: float, least: int) -> list[int]:
    """The same by all splits, for tests."""
    n = len(x)
    best, back = [math.inf] * (n + 1), [0] * (n + 1)
    best[0] = -penalty
    for e in range(least, n + 1):
        for a in range(0, e - least + 1):
            if math.isfinite(best[a]):
                c = best[a] + float(((x[a:e] - x[a:e].mean()) ** 2).sum()) + penalty
                if c < best[e] - 1e-12:
                    best[e], back[e] = c, a
    out, e = [], n
    while e > 0 and back[e] > 0:
        e = back[e]
        out.append(e)
    return out[::-1]


def bandwidth(x: np.ndarray) -> float:
    """One over the median squared distance of two different points; 1 where that is 0."""
    d = np.square(x[:, None] - x[None])[np.triu_indices(len(x), 1)]
    mid = float(np.median(d)) if len(d) else 0.0
    return 1 / mid if mid > 0 else 1.0


def pelt_kernel(x: np.ndarray, penalty: float, least: int, gamma: float | None = None) -> list[int]:
    """Starts of the segments but the first, for the spread around segment means in the space of the Gaussian kernel.

    A segment's cost is its length less the mean of its block of the kernel's matrix, whose prefix sums take n * n
    numbers: a series is as long as its calendar.
    """
    n = len(x)
    gram = np.exp(-(bandwidth(x) if gamma is None else gamma) * np.square(x[:, None] - x[None]))
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = gram.cumsum(axis=0).cumsum(axis=1)
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, int)
    for e in range(least, n + 1):
        a = np.arange(0, e - least + 1)
        block = total[e, e] - total[a, e] - total[e, a] + total[a, a]
        cost = best[a] + (e - a) - block / (e - a)
        k = int(np.argmin(cost))
        best[e], back[e] = cost[k] + penalty, a[k]
    out, e = [], n
    while e > 0 and back[e] > 0:
        e = int(back[e])
        out.append(e)
    return out[::-1]


def series_summary(df: DataFrame, by: str, order: str, x: str, least: int = 5, beta: float = 2.0) -> DataFrame:
    """A row for each series: whether it could be searched (ok, short, constant), its points, and what each method finds (places joined by commas).

    A series is one task. Values are scaled by the noise of their differences. Nulls are left out.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x"]).sort_values("o")
        v, o = pdf["x"].to_numpy(float), pdf["o"].to_numpy()
        status = "short" if len(v) < 2 * least else "constant" if np.ptp(v) == 0 else "ok"
        found: dict[str, list[int]] = {"means": [], "kernel": [], "online": []}
        if status == "ok":
            d = np.diff(v)
            sigma = np.median(np.abs(d - np.median(d))) / 0.67449 / math.sqrt(2) or d.std() / math.sqrt(2)
            z = (v - np.median(v)) / sigma
            found["means"] = pelt(z, beta * math.log(len(z)), least)
            found["kernel"] = pelt_kernel(z, 0.5 * math.log(len(z)), least)
            length = bocpd(z, 0.01)
            found["online"] = [i for i in range(1, len(z)) if length[i] < length[i - 1]]
        return pd.DataFrame({"by": [key[0]], "status": [status], "n": [len(v)], **{k: [",".join(str(o[i]) for i in at)] for k, at in found.items()}})

    rows = df.select(F.col(by).cast("string").alias("by"), F.col(order).cast("long").alias("o"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("by").applyInPandas(run, "by string, status string, n long, means string, kernel string, online string")


#: Prior of a segment's mean and precision: mean, kappa, alpha, beta.
PRIOR = (0.0, 1.0, 1.0, 1.0)
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def student_t_logpdf(x: np.ndarray, df: np.ndarray | float, loc: np.ndarray | float, scale: np.ndarray | float) -> np.ndarray:
    """Log density of Student's t with a place and a scale."""
    df = np.asarray(df, float)
    return _lgamma((df + 1) / 2) - _lgamma(df / 2) - 0.5 * np.log(df * math.pi * np.square(scale)) - (df + 1) / 2 * np.log1p(np.square((x - loc) / scale) / df)


def bocpd_step(state: list[np.ndarray] | None, v: float, hazard: float) -> tuple[list[np.ndarray], int]:
    """The posterior over run lengths (log-weights and Normal-Gamma values) after one more point, and the likeliest run length."""
    logp, m, k, a, b = state if state is not None else [np.zeros(1), *(np.array([x]) for x in PRIOR)]
    joint = logp + student_t_logpdf(v, 2 * a, m, np.sqrt(b * (k + 1) / (a * k)))
    top = joint.max()
    change = top + math.log(np.exp(joint - top).sum()) + math.log(hazard)
    logp = np.concatenate(([change], joint + math.log1p(-hazard)))
    logp -= logp.max() + math.log(np.exp(logp - logp.max()).sum())
    b = np.concatenate(([PRIOR[3]], b + k * (v - m) ** 2 / (2 * (k + 1))))
    m = np.concatenate(([PRIOR[0]], (k * m + v) / (k + 1)))
    k, a = np.concatenate(([PRIOR[1]], k + 1)), np.concatenate(([PRIOR[2]], a + 0.5))
    return [logp, m, k, a, b], int(np.argmax(logp[1:])) + 1


def bocpd(x: np.ndarray, hazard: float) -> np.ndarray:
    """The likeliest run length after each point; it counts the point."""
    state, out = None, np.zeros(len(x), int)
    for i, v in enumerate(x):
        state, out[i] = bocpd_step(state, float(v), hazard)
    return out


def detect(df: DataFrame, by: str, order: str, x: str, beta: float = 2.0, least: int = 5) -> DataFrame:
    """Change points of each series by PELT on values scaled by the noise, with penalty beta * ln n, and by the online method.

    A series is one task; series are as long as their calendar.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        v = pdf["x"].to_numpy(float)
        d = np.diff(v)
        mad = np.median(np.abs(d - np.median(d))) / 0.67449 / math.sqrt(2) if len(d) else 0.0
        sigma = mad or (d.std() / math.sqrt(2) if len(d) else 1.0) or 1.0
        z = (v - np.median(v)) / sigma
        at = pelt(z, beta * math.log(max(2, len(z))), least) if len(z) >= 2 * least else []
        run_length = bocpd(z, min(0.5, 1 / 100)) if len(z) else np.zeros(0, int)
        edges = [0, *at, len(z)]
        means = [v[a:b].mean() for a, b in zip(edges, edges[1:])]
        return pd.DataFrame({"by": pdf["by"].iloc[0], "at": pdf["o"].to_numpy()[at], "before": means[:-1], "after": means[1:], "online": [bool((run_length[max(0, a - 1) : a + least] <= least).any()) for a in at]})

    rows = df.select(F.col(by).cast("string").alias("by"), F.col(order).cast("long").alias("o"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("by").applyInPandas(run, "by string, at long, before double, after double, online boolean")


def aligned(points: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """How many points (at) lie within width days of an entry (lo to hi)."""
    # Entries are widened to days, of which there are as many as the calendar has.
    days = entries.select(F.explode(F.sequence(F.col("lo") - width, F.col("hi") + width)).alias("at")).distinct()
    return points.join(days, "at", "left_semi").agg(F.count("*").alias("s"))


def shift_null(points: DataFrame, entries: DataFrame, n_days: int, width: int) -> DataFrame:
    """(offset, s): the statistic with entries moved around the calendar (days 0 to n_days - 1) by each offset of the exact null."""
    spark = points.sparkSession
    days = entries.select(F.explode(F.sequence(F.col("lo") - width, F.col("hi") + width)).alias("day")).distinct()
    moved = days.crossJoin(F.broadcast(spark.range(2 * width + 1, n_days - 2 * width).withColumnRenamed("id", "offset")))  # calendar days by calendar days
    moved = moved.select("offset", F.pmod(F.col("day") + F.col("offset"), F.lit(n_days)).alias("at")).distinct()
    n = points.groupBy("at").agg(F.count("*").alias("n"))
    return moved.join(n, "at", "left").groupBy("offset").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"))
