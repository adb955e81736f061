"""Group statistics as column expressions and small compositions: inequality, ranks, agreement, slopes, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of value in each group: sum((2k - n - 1) x_k) / (n sum x), x ascending.

    Equal values are counted before they are ranked, so a group is as long as it has different values.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_m"))
    w = W.partitionBy(*by).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    v = v.withColumn("_r", F.sum("_m").over(w))
    # The ranks of m equal values end at r: they add up to m * (2r - m + 1) / 2.
    ranks = F.col("_m") * (2 * F.col("_r") - F.col("_m") + 1)
    g = v.groupBy(*by).agg(F.sum(ranks * F.col("_x")).alias("_a"), F.sum(F.col("_m") * F.col("_x")).alias("_s"), F.sum("_m").alias("n"))
    return g.select(*by, "n", F.when(F.col("_s") != 0, (F.col("_a") - (F.col("n") + 1) * F.col("_s")) / (F.col("n") * F.col("_s"))).alias("gini"))


def top_share(df: DataFrame, by: list[str], value: str, share: float, tie: str) -> DataFrame:
    """What part of a group's sum its top rows have: ceil(share * n) rows, by value, then tie."""
    w = W.partitionBy(*by)
    r = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc(value), tie))).withColumn("_n", F.count("*").over(w))
    return r.groupBy(*by).agg((F.sum(F.when(F.col("_k") <= F.ceil(share * F.col("_n")), F.col(value)).otherwise(0)) / F.sum(value)).alias("top_share"))


def average_rank(by: list[str], value: str) -> Column:
    """Rank of value in its group from 1; equal values share the mean of their ranks."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def mid_rank(by: list[str], value: str) -> Column:
    """The share of a group below a value, half of the equal ones (the value itself too) counted."""
    w = W.partitionBy(*by)
    return (F.rank().over(w.orderBy(value)) - 1 + F.count("*").over(W.partitionBy(*by, value)) / 2) / F.count("*").over(w)


def slope(df: DataFrame, by: list[str], within: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x in each group, both less their means of each `within`."""
    w = W.partitionBy(*by, within)
    d = df.withColumn("_x", F.col(x) - F.avg(x).over(w)).withColumn("_y", F.col(y) - F.avg(y).over(w))
    return d.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters' labels."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sa = n.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    sb = n.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = sa.join(sb, "label").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    total = n.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    both = total.crossJoin(chance)  # a row each
    pe, po = F.col("chance") / (F.col("n") * F.col("n")), F.col("agree") / F.col("n")
    return both.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def prf(df: DataFrame, by: list[str], truth: Column, said: Column, weight: Column) -> DataFrame:
    """Weighted precision, recall, F1 and accuracy."""
    tp, fp, fn = (F.sum(F.when(c, weight).otherwise(0.0)) for c in (truth & said, ~truth & said, truth & ~said))
    g = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.sum(weight).alias("all"), F.sum(F.when(truth == said, weight).otherwise(0.0)).alias("ok"))
    some = lambda a, b: F.when(b > 0, a / b)
    p, r = some(F.col("tp"), F.col("tp") + F.col("fp")), some(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*by, p.alias("precision"), r.alias("recall"), some(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("ok") / F.col("all")).alias("accuracy"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the Wilson interval of k of n."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def holm(df: DataFrame, by: list[str], p: str, tie: str) -> Column:
    """Holm's adjustment: running maximum of (m - rank + 1) p, at most 1."""
    w = W.partitionBy(*by)
    order = w.orderBy(p, tie)
    step = (F.count("*").over(w) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0)))).drop("_step")


def permanent_random(seed: str, *keys: Column) -> Column:
    """A hex string, as good as random, that stays with a row's keys: the smallest k are a stable sample."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *keys), 256)


def log_odds(counts: DataFrame, word: str, family: str, n: str, prior: float) -> DataFrame:
    """Log-odds of words in a family against the rest, with a prior of that many words spread as all are, and its z."""
    a = counts.withColumn("_y", F.sum(n).over(W.partitionBy(word)))
    fam = counts.groupBy(family).agg(F.sum(n).alias("_nf"))
    total = counts.agg(F.sum(n).alias("_all"))
    a = a.join(F.broadcast(fam), family).crossJoin(F.broadcast(total))  # families are few, the total is one row
    own, rest, nr = F.col(n), F.col("_y") - F.col(n), F.col("_all") - F.col("_nf")
    p = prior * F.col("_y") / F.col("_all")
    delta = F.log((own + p) / (F.col("_nf") + prior - own - p)) - F.log((rest + p) / (nr + prior - rest - p))
    return a.select(word, family, n, delta.alias("delta"), (delta / F.sqrt(1 / (own + p) + 1 / (rest + p))).alias("z"))
