"""Streaming forms of the segmentation and of daily counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import shift
from eventloom.shared import shared_dir


def stream_blocks(events: DataFrame, ts: str, gap_s: int, by: list[str], late: str = "1 hour") -> DataFrame:
    """Run blocks of a stream: sessions with a gap, cut at dates; the end is the last row's time, not the session's.

    A session ends a gap after its last row; rows exactly a gap apart are one block, as in the batch form.
    """
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(*by, F.to_date("_t").alias("date"), F.session_window("_t", f"{gap_s} seconds"))
    return g.agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("n_rows")).drop("session_window")


def stream_daily(events: DataFrame, ts: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of each day; a day's count is final once the watermark is past it."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(*by, F.window("_t", "1 day")).agg(F.count("*").alias("n")).select(*by, F.col("window.start").cast("date").alias("date"), "n")


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for what there is now, as a table in the shared folder; nothing is gathered at the driver.

    append writes files as rows become final. Other modes write each batch's whole result over the last one's, from
    the executors.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_candidates(left: DataFrame, right: DataFrame, by: list[str], ts: str, lo_s: float, hi_s: float, late: str = "1 hour") -> DataFrame:
    """Pairs (by, lid, rid, dt) of two streams' rows of the same keys with lo_s <= right - left <= hi_s.

    Both sides are kept no longer than the window and the lateness ask for.
    """
    a = left.select(*by, F.col("id").alias("lid"), F.col(ts).cast("timestamp").alias("lt")).withWatermark("lt", late)
    b = right.select(*(F.col(k).alias(f"r_{k}") for k in by), F.col("id").alias("rid"), F.col(ts).cast("timestamp").alias("rt")).withWatermark("rt", late)
    same = F.lit(True)
    for k in by:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    close = F.expr(f"rt >= lt + INTERVAL {lo_s} SECONDS AND rt <= lt + INTERVAL {hi_s} SECONDS")
    return a.join(b, same & close).select(*by, "lid", "rid", ((F.unix_micros("rt") - F.unix_micros("lt")) / 1e6).alias("dt"))


def stream_runs(points: DataFrame, by: str, order: str, x: str, hazard: float) -> DataFrame:
    """(by, order, run): Bayesian online run lengths; the posterior of each series is state between batches.

    Rows of a series come in order of batches, and are sorted within one. The state has five numbers for each point
    that the series has had so far.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [np.array(v) for v in state.get] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("o")
        at, lengths = held, []
        for v in rows["x"].to_numpy(float):
            at, length = shift.bocpd_step(at, float(v), hazard)
            lengths.append(length)
        state.update(tuple(a.tolist() for a in at))
        yield pd.DataFrame({"by": key[0], "o": rows["o"].to_numpy(), "run": lengths})

    rows = points.select(F.col(by).cast("string").alias("by"), F.col(order).cast("long").alias("o"), F.col(x).cast("double").alias("x"))
    state = "logp array<double>, m array<double>, k array<double>, a array<double>, b array<double>"
    return rows.groupBy("by").applyInPandasWithState(run, "by string, o long, run int", state, "append", "NoTimeout")


#: Keys are dealt into so many groups, each with one state: a key costs a few numbers, not a call of Python.
GROUPS = 1 << 12


def stream_last_writers(touches: DataFrame, key: str, who: str, t: str, groups: int = GROUPS) -> DataFrame:
    """(who, parent, key) of a stream of first touches (a row for each key and toucher): the latest other one that came strictly earlier.

    The state of a key is its latest time, the greatest toucher of that time, and that of the time before, if any.
    Rows of a key come in order of batches, and are sorted within one; times are numbers. Keys are handled a group at
    once, by arrays.
    """
    names = ("key", "t", "who", "before", "has")

    def run(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        new = [rows[c].to_numpy(np.int64) for c in names[:3]]
        held = [np.array(v, np.int64) for v in state.get] if state.exists else [np.empty(0, np.int64)] * 5
        # What is held stands as one row for its key, before those of this batch.
        k, at, w = (np.concatenate([a, b]) for a, b in zip(held, new))
        old = np.arange(len(k)) < len(held[0])
        past, has = np.zeros(len(k), np.int64), np.zeros(len(k), bool)
        past[old], has[old] = held[3], held[4] == 1
        o = np.lexsort((w, at, k))
        k, at, w, old, past, has = (x[o] for x in (k, at, w, old, past, has))
        # Runs of one key and time: the last of a run is its greatest toucher, and all of a run have one past.
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (at[1:] != at[:-1])])
        ends = np.r_[starts[1:], len(k)] - 1
        same = np.r_[False, k[starts[1:]] == k[starts[:-1]]]
        prior = np.where(same, w[np.r_[0, ends[:-1]]], 0)
        known = same.copy()
        # The run that what is held belongs to, the first of its key, has the past that is held.
        run_of = np.repeat(np.arange(len(starts)), ends - starts + 1)
        mine = run_of[old]
        prior[mine], known[mine] = np.where(has[old], past[old], prior[mine]), has[old] | known[mine]
        got = ~old & known[run_of]
        last = np.flatnonzero(np.r_[k[starts[1:]] != k[starts[:-1]], True])
        state.update(tuple(x.tolist() for x in (k[starts[last]], at[starts[last]], w[ends[last]], prior[last], known[last].astype(np.int64))))
        yield pd.DataFrame({"who": w[got], "parent": prior[run_of][got], "key": k[got]})

    rows = touches.select(F.col(key).cast("long").alias("key"), F.col(who).cast("long").alias("who"), F.col(t).cast("long").alias("t"))
    rows = rows.where("key IS NOT NULL AND who IS NOT NULL AND t IS NOT NULL")
    state = ", ".join(f"{n} array<long>" for n in names)
    return rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInPandasWithState(run, "who long, parent long, key long", state, "append", "NoTimeout")
