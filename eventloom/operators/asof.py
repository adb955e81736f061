"""As-of lookups, candidate windows and one-to-one matching of records in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.shared import discard, materialize


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], direction: str = "backward", strict: bool = False, tolerance: float | None = None, tie: str | None = None, prefix: str = "") -> DataFrame:
    """left with the values of the nearest right row of the same keys.

    backward: the latest right row at or before left_on (strict: before); forward: the earliest at or after.
    tolerance: the values are null where the distance is greater; left rows always stay. Of right rows with equal
    right_on, the one with the greatest tie is nearest backward, the one with the least forward. Rows with a null
    key or time match nothing. One exchange by the keys serves both sides; there is no join.
    """
    forward = direction == "forward"
    tie = tie or right_on
    payload = F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values)), F.col(right_on).alias("at"))
    known = right.where(F.col(right_on).isNotNull())
    for b in by:
        known = known.where(F.col(b).isNotNull())
    rows_l = left.select(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by)), F.col(left_on).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.struct(*left.columns).alias("row"), F.lit(None).cast(known.select(payload.alias("p")).schema["p"].dataType).alias("found"))
    rows_r = known.select(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by)), F.col(right_on).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.lit(None).cast(rows_l.schema["row"].dataType).alias("row"), payload.alias("found"))
    side = F.col("side") if not strict else -F.col("side")
    order = [F.col("t").desc_nulls_last(), side, F.col("tie").desc()] if forward else [F.col("t").asc_nulls_first(), side, F.col("tie")]
    w = W.partitionBy(*(f"k{i}" for i in range(len(by)))).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    got = rows_l.unionByName(rows_r).withColumn("hit", F.last("found", ignorenulls=True).over(w)).where("side = 1")
    ok = F.col("t").isNotNull()
    for i in range(len(by)):
        ok = ok & F.col(f"k{i}").isNotNull()
    if tolerance is not None:
        ok = ok & (F.abs(micros(F.col("hit.at")) - micros(F.col("t"))) <= int(tolerance * 1e6))
    return got.select("row.*", *(F.when(ok, F.col(f"hit.v{i}")).alias(prefix + v) for i, v in enumerate(values)))


def window_candidates(left: DataFrame, right: DataFrame, by: list[str], left_id: str, left_on: str, right_id: str, right_on: str, lo_s: float, hi_s: float, most: int) -> DataFrame:
    """(left_id, right_id, dt): right rows of the same keys with lo_s <= right - left <= hi_s, the first `most` of each left row.

    Times are cut into slots as wide as the window, and each left row asks for the slots its window touches, so the
    join is by equality and no key's rows are compared all with all.
    """
    width = max(1, int((hi_s - lo_s) * 1e6))
    a = left.select(*by, F.col(left_id).alias("lid"), micros(left_on).alias("lt"))
    a = a.withColumn("slot", F.explode(F.sequence(F.floor((F.col("lt") + int(lo_s * 1e6)) / width), F.floor((F.col("lt") + int(hi_s * 1e6)) / width))))
    b = right.select(*by, F.col(right_id).alias("rid"), micros(right_on).alias("rt")).withColumn("slot", F.floor(F.col("rt") / width))
    dt = F.col("rt") - F.col("lt")
    pairs = a.join(b, [*by, "slot"]).where(dt.between(int(lo_s * 1e6), int(hi_s * 1e6)))
    n = F.row_number().over(W.partitionBy("lid").orderBy("rt", "rid"))
    return pairs.withColumn("n", n).where(F.col("n") <= most).select("lid", "rid", (dt / 1e6).alias("dt"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """A one-to-one subset of pairs (lid, rid, cost): what taking them by (cost, lid, rid), if both ids are free, gives.

    Rounds: a pair that is the first of both its ids is taken, and all pairs of these ids go. Each round is written
    to the shared folder, so the plan does not grow and a lost executor costs a round at most.
    """
    rest = materialize(pairs.select("lid", "rid", "cost"), "pairs")
    taken = None
    while rest.take(1):
        key = F.struct("cost", "lid", "rid")
        first = rest.groupBy("lid").agg(F.min(key).alias("k")).select("k.*").join(rest.groupBy("rid").agg(F.min(key).alias("k")).select("k.*"), ["cost", "lid", "rid"])
        got = materialize(first.select("lid", "rid", "cost"), "matched")
        taken = got if taken is None else taken.unionByName(got)
        old = rest
        rest = materialize(rest.join(got.select("lid"), "lid", "left_anti").join(got.select("rid"), "rid", "left_anti"), "pairs")
        discard(old)
    return taken if taken is not None else rest
