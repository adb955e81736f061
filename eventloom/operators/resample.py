"""Resampling as task tables: a row for each replicate and cluster, with a weight that only its ids decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that the seed and keys decide: 48 bits of a hash that every engine has."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def unit_sql(seed: int, *keys: str) -> str:
    """The same as SQL."""
    parts = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5({parts}), 1, 12) AS BIGINT) / {float(1 << 48)!r})"


def _poisson_steps(most: int) -> list[tuple[float, int]]:
    steps, cum = [], 0.0
    for k in range(most):
        cum += math.exp(-1) / math.factorial(k)
        steps.append((cum, k))
    return steps


def poisson1_sql(u: str, most: int = 8) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c!r} THEN {k}" for c, k in _poisson_steps(most)) + f" ELSE {most} END"


def poisson1(u: Column, most: int = 8) -> Column:
    """A Poisson variable of mean 1 from a uniform one, by its distribution function."""
    out = F.lit(most)
    for c, k in reversed(_poisson_steps(most)):
        out = F.when(u < c, k).otherwise(out)
    return out


def bootstrap_ratio(clusters: DataFrame, by: list[str], cluster: str, num: str, den: str, reps: int, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Ratio of sums in each group with a percentile interval of a Poisson bootstrap over clusters.

    clusters: a row for each group and cluster, already summed. Replicates are rows, and reduce map-side; one that
    draws none of a group's clusters has no ratio, and is left out of its interval.
    """
    spark = clusters.sparkSession
    rep = spark.range(reps).withColumnRenamed("id", "rep")
    # A stated number of replicates for every cluster row.
    drawn = clusters.crossJoin(F.broadcast(rep)).withColumn("w", poisson1(unit(seed, F.col("rep"), F.col(cluster))))
    stat = drawn.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(num)), F.sum(F.col("w") * F.col(den))).alias("r"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ends = stat.groupBy(*by).agg(F.percentile("r", F.lit(lo)).alias("lo"), F.percentile("r", F.lit(hi)).alias("hi"))
    point = clusters.groupBy(*by).agg(F.try_divide(F.sum(num), F.sum(den)).alias("ratio"))
    return point.join(ends, by)


def permutation_test(rows: DataFrame, stratum: str, label: str, value: str, row_id: str, reps: int, seed: int = 2) -> DataFrame:
    """Difference of means of two labels (0, 1) with its two-sided p-value when labels are dealt anew within strata."""
    spark = rows.sparkSession
    w = W.partitionBy("rep", stratum).orderBy("u", row_id)
    n1 = rows.groupBy(stratum).agg(F.sum(label).alias("n1"))
    rep = spark.range(reps).withColumnRenamed("id", "rep")
    dealt = rows.crossJoin(F.broadcast(rep)).withColumn("u", unit(seed, F.col("rep"), F.col(row_id))).withColumn("k", F.row_number().over(w)).join(n1, stratum).withColumn("one", F.col("k") <= F.col("n1"))
    null = dealt.groupBy("rep").agg((F.avg(F.when(F.col("one"), F.col(value))) - F.avg(F.when(~F.col("one"), F.col(value)))).alias("d"))
    own = rows.agg((F.avg(F.when(F.col(label) == 1, F.col(value))) - F.avg(F.when(F.col(label) == 0, F.col(value)))).alias("diff"))
    return null.crossJoin(own).groupBy("diff").agg(((1 + F.count_if(F.abs("d") >= F.abs("diff"))) / (1 + F.count("*"))).alias("p"))
