"""Time segmentation: run blocks by gap, pauses, main blocks, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.operators.asof import asof
from eventloom.shared import materialize


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference of two timestamps in seconds."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def run_blocks(events: DataFrame, ts: str, gap_s: float, by: tuple[str, ...] = (), bucket_s: int = 3600) -> DataFrame:
    """Maximal runs of rows on one date with no gap of more than gap_s seconds.

    A gap of exactly gap_s does not split. Rows without a time belong to no block. Rows are cut into runs within
    buckets of bucket_s seconds first, so that a date is many windows; then the runs, some for each bucket, are put
    together by date.
    Returns: the by columns, date, block (from 1), start, end, n_rows, duration_s.
    """
    rows = events.where(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_ts"), F.to_date(ts).alias("date"))
    # Rows with equal times cannot differ in block, so they are counted before the windows.
    ticks = rows.groupBy(*by, "date", "_ts").agg(F.count("*").alias("_n"))
    ticks = ticks.withColumn("_bucket", F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / (bucket_s * 1_000_000)))
    inner = W.partitionBy(*by, "date", "_bucket").orderBy("_ts")
    split = F.coalesce((seconds_between(F.col("_ts"), F.lag("_ts").over(inner)) > gap_s).cast("int"), F.lit(0))
    marked = ticks.withColumn("_new", split).withColumn("_run", F.sum("_new").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "date", "_bucket", "_run").agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.sum("_n").alias("n_rows"))
    w = W.partitionBy(*by, "date").orderBy("start")
    gap = seconds_between(F.col("start"), F.lag("end").over(w))
    numbered = runs.withColumn("_new", F.when(gap.isNull() | (gap > gap_s), 1).otherwise(0)).withColumn("block", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*by, "date", "block")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_rows").alias("n_rows"))
        .withColumn("duration_s", seconds_between(F.col("end"), F.col("start")))
    )


def pauses(blocks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The gaps between successive blocks of one date, with the blocks on either side."""
    w = W.partitionBy(*by, "date").orderBy("block")
    return (
        blocks.select(*by, "date", F.col("block").alias("before"), F.col("end").alias("pause_start"), F.lead("block").over(w).alias("after"), F.lead("start").over(w).alias("pause_end"))
        .where(F.col("after").isNotNull())
        .withColumn("pause_s", seconds_between(F.col("pause_end"), F.col("pause_start")))
    )


def main_blocks(blocks: DataFrame, from_hour: int, to_hour: int) -> DataFrame:
    """blocks with is_main and rank: the main block of a date overlaps the schedule most, then lasts longest, then is first.

    The main block has rank 0; those before it count from 1, and those after it go on from there.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    day = us(F.col("date").cast("timestamp"))
    overlap = F.greatest(F.lit(0), F.least(us(F.col("end")), day + to_hour * 3_600_000_000) - F.greatest(us(F.col("start")), day + from_hour * 3_600_000_000))
    first = F.row_number().over(W.partitionBy("date").orderBy(F.desc("overlap"), F.desc("duration_s"), "start"))
    main = F.max(F.when(F.col("n") == 1, F.col("block"))).over(W.partitionBy("date"))
    got = blocks.withColumn("overlap", overlap).withColumn("n", first).withColumn("main", main)
    rank = F.when(F.col("block") == F.col("main"), 0).when(F.col("block") < F.col("main"), F.col("block")).otherwise(F.col("block") - 1)
    return got.withColumn("is_main", F.col("block") == F.col("main")).withColumn("rank", rank.cast("long")).drop("overlap", "n", "main")


#: Blocks up to which they are sent to all tasks, of about 60 bytes each.
FEW_BLOCKS = 200_000


def run_columns(rows: DataFrame, blocks: DataFrame, ts: str, few: int = FEW_BLOCKS) -> DataFrame:
    """rows with date, run_day, block, in_run, t_in_day and t_active.

    A row's block is the latest of its date that has begun, else the date's first. t_in_day may be negative; t_active
    is the active time of all blocks so far, and stands still between blocks. Blocks are numbered in one task and
    written; up to `few` of them are sent to all tasks, a list for each date, and rows are not shuffled. More are
    looked up by date, to which rows are dealt out.
    """
    order = W.orderBy("start")
    known = (
        blocks.withColumn("before", F.coalesce(F.sum("duration_s").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("run_day", F.dense_rank().over(W.orderBy("date")).cast("long"))
        .select("date", "start", "end", "block", "run_day", "before")
    )
    known = materialize(known, "blocks")
    dated = rows.withColumn("date", F.to_date(ts))
    names = ("start", "end", "block", "run_day", "before")
    if known.count() <= few:
        lists = known.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_blocks"))
        begun = F.element_at(F.filter("_blocks", lambda x: x["start"] <= F.col(ts)), -1)
        found = dated.join(F.broadcast(lists), "date", "left").withColumn("_b", F.when(F.exists("_blocks", lambda x: x["start"] <= F.col(ts)), begun)).withColumn("_f", F.get("_blocks", F.lit(0)))
        b_, f_ = {c: F.col(f"_b.{c}") for c in names}, {c: F.col(f"_f.{c}") for c in names}
    else:
        first = known.groupBy("date").agg(F.min(F.struct(*names)).alias("_f"))
        found = asof(dated, known, ["date"], ts, "start", list(names), prefix="b_").join(first, "date", "left")
        b_, f_ = {c: F.col(f"b_{c}") for c in names}, {c: F.col(f"_f.{c}") for c in names}
    # Before a date's first block the clock stands where the last block of an earlier date left it.
    b = {c: F.coalesce(b_[c], f_[c]) for c in names}
    t = F.col(ts)
    active = F.when(b_["start"].isNotNull(), b_["before"] + seconds_between(F.least(t, b_["end"]), b_["start"])).otherwise(f_["before"])
    return found.select(*dated.columns, b["run_day"].alias("run_day"), b["block"].alias("block"), ((t >= b["start"]) & (t <= b["end"])).alias("in_run"), seconds_between(t, b["start"]).alias("t_in_day"), active.alias("t_active"))


def recent_counts(rows: DataFrame, by: list[str], row_id: str, us: str, span: int, width: int) -> DataFrame:
    """(row_id, n): how many rows of the same keys are less than or exactly `span` before each row, itself and ties left out; us and spans are whole microseconds.

    Of times, those before a row less those before the reach of the span: each is the rows of earlier slots, a number
    for each slot, and the rows before it in its own. So a key's rows are as many windows as it has slots of `width`.
    """
    points = rows.select(*by, F.col(row_id).alias("_id"), F.explode(F.array(F.struct(F.col(us).alias("x"), F.lit(1).alias("n")), F.struct((F.col(us) - span).alias("x"), F.lit(0).alias("n")))).alias("_p"))
    points = points.select(*by, "_id", "_p.x", "_p.n", F.floor(F.col("_p.x") / width).alias("_slot"))
    slots = points.groupBy(*by, "_slot").agg(F.sum("n").alias("_in"))
    slots = slots.withColumn("_before", F.coalesce(F.sum("_in").over(W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    own = F.coalesce(F.sum("n").over(W.partitionBy(*by, "_slot").orderBy("x").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = points.withColumn("_own", own).join(slots, [*by, "_slot"]).withColumn("_n", (F.col("_own") + F.col("_before")) * F.when(F.col("n") == 1, 1).otherwise(-1))
    return told.groupBy(F.col("_id").alias(row_id)).agg(F.sum("_n").alias("n"))


def spells(rows: DataFrame, by: list[str], ts: str, state: str, tie: str) -> DataFrame:
    """(by, state, start, end): a spell begins where the state is not that of the row before, and ends where the next begins."""
    w = W.partitionBy(*by).orderBy(ts, tie)
    fresh = rows.select(*by, ts, tie, F.col(state).alias("state"), F.lag(state).over(w).alias("last")).where(F.col("last").isNull() | (F.col("last") != F.col("state")))
    return fresh.select(*by, "state", F.col(ts).alias("start"), F.lead(ts).over(w).alias("end"))
