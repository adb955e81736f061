"""Queries on the event stream: segmentation into blocks, pauses, spells and clocks, and window functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import segment
from eventloom.operators.asof import asof, micros
from eventloom.session import table

GAP_S = 900


def _events(s, d, kind=None):
    e = table(s, d, "events")
    return e if kind is None else e.where(F.col("event_type") == kind)


def _blocks(s, d):
    return segment.run_blocks(_events(s, d), "ts", GAP_S, ("user_id",))


def blocks_sql(gap: int, where: str = "true", by: str = "user_id, ") -> str:
    keys = f"{by}CAST(ts AS DATE)"
    return f"""
SELECT {by}date, CAST(block AS BIGINT) AS block, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by}date ORDER BY ts RANGE UNBOUNDED PRECEDING) AS block
      FROM (SELECT {by}CAST(ts AS DATE) AS date, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {gap * 1000000} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
            FROM events WHERE ts IS NOT NULL AND {where} WINDOW w AS (PARTITION BY {keys} ORDER BY ts)))
GROUP BY ALL"""


BLOCKS_SQL = blocks_sql(GAP_S)
PAUSES_SQL = f"""
WITH b AS ({BLOCKS_SQL}),
     p AS (SELECT user_id, date, block AS before, "end" AS pause_start, lead(block) OVER w AS after, lead(start) OVER w AS pause_end
           FROM b WINDOW w AS (PARTITION BY user_id, date ORDER BY block))
SELECT *, (epoch_us(pause_end) - epoch_us(pause_start)) / 1e6 AS pause_s FROM p WHERE after IS NOT NULL"""

#: The schedule whose overlap makes a block a date's main one, in hours.
SCHEDULE = (9, 17)


def main_block(s, d):
    b = segment.run_blocks(_events(s, d), "ts", GAP_S)
    return segment.main_blocks(b, *SCHEDULE).select("date", "start", "rank", "is_main")


MAIN_SQL = f"""
WITH b AS ({blocks_sql(GAP_S, by='')}),
     o AS (SELECT *, greatest(0, least(epoch_us("end"), epoch_us(date + INTERVAL {SCHEDULE[1]} HOUR)) - greatest(epoch_us(start), epoch_us(date + INTERVAL {SCHEDULE[0]} HOUR))) AS overlap FROM b),
     r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY overlap DESC, duration_s DESC, start) AS n FROM o),
     m AS (SELECT date, block AS main FROM r WHERE n = 1)
SELECT date, start, CAST(CASE WHEN block = main THEN 0 WHEN block < main THEN block ELSE block - 1 END AS BIGINT) AS rank, block = main AS is_main FROM r JOIN m USING (date)"""


def run_columns(s, d):
    b = segment.run_blocks(_events(s, d, "click"), "ts", GAP_S)
    return segment.run_columns(_events(s, d, "view").select("event_id", "ts"), b, "ts").select("event_id", "run_day", "block", "in_run", F.round("t_in_day", 6).alias("t_in_day"), F.round("t_active", 6).alias("t_active"))


RUN_COLUMNS_SQL = f"""
WITH b AS ({blocks_sql(GAP_S, "event_type = 'click'", '')}),
     c AS (SELECT *, coalesce(sum(duration_s) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, dense_rank() OVER (ORDER BY date) AS run_day FROM b),
     f AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY start) AS k FROM c),
     e AS (SELECT event_id, ts, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view'),
     h AS (SELECT e.*, coalesce(c.start, g.start) AS start, coalesce(c."end", g."end") AS "end", coalesce(c.block, g.block) AS block, coalesce(c.run_day, g.run_day) AS run_day
           FROM e ASOF LEFT JOIN c ON e.date = c.date AND e.ts >= c.start LEFT JOIN (SELECT * FROM f WHERE k = 1) g ON e.date = g.date),
     a AS (SELECT h.*, c.before, c.start AS last_start, c."end" AS last_end FROM h ASOF LEFT JOIN c ON h.ts >= c.start)
SELECT event_id, run_day, block, ts >= start AND ts <= "end" AS in_run, round((epoch_us(ts) - epoch_us(start)) / 1e6, 6) AS t_in_day,
       round(CASE WHEN last_start IS NULL THEN 0 ELSE before + (epoch_us(least(ts, last_end)) - epoch_us(last_start)) / 1e6 END, 6) AS t_active
FROM a"""


def gap_sensitivity(s, d):
    parts = [segment.run_blocks(_events(s, d), "ts", g * 60, ("user_id",)).agg(F.lit(g).alias("gap_min"), F.count("*").alias("n_blocks"), F.round(F.sum("duration_s"), 3).alias("active_s")) for g in (15, 30, 60)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GAP_SQL = " UNION ALL ".join(f"SELECT {g} AS gap_min, count(*) AS n_blocks, round(sum(duration_s), 3) AS active_s FROM ({blocks_sql(g * 60)})" for g in (15, 30, 60))


def spells(s, d):
    return segment.spells(_events(s, d), ["user_id"], "ts", "event_type", "event_id")


SPELLS_SQL = """
WITH c AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     x AS (SELECT * FROM c WHERE p IS NULL OR p <> event_type)
SELECT user_id, event_type AS state, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "end" FROM x"""


def state_at(s, d):
    left = _events(s, d, "error").select("event_id", "user_id", "ts")
    return asof(left, spells(s, d), ["user_id"], "ts", "start", ["state"], strict=True)


STATE_AT_SQL = f"SELECT l.event_id, l.user_id, l.ts, x.state FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN ({SPELLS_SQL}) x ON l.user_id = x.user_id AND l.ts > x.start"


def open_session(s, d):
    b = segment.run_blocks(_events(s, d, "click"), "ts", 7200, ("user_id",)).select("user_id", "date", "block", "start", "end")
    left = _events(s, d, "purchase").select("event_id", "user_id", "ts")
    got = asof(left, b, ["user_id"], "ts", "start", ["date", "block", "end"])
    return got.select("event_id", F.when(F.col("ts") <= F.col("end"), F.concat_ws("/", "date", "block")).alias("session"))


OPEN_SQL = f"""
SELECT l.event_id, CASE WHEN l.ts <= b."end" THEN b.date || '/' || b.block END AS session
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN ({blocks_sql(7200, "event_type = 'click'")}) b ON l.user_id = b.user_id AND l.ts >= b.start"""


def clock(s, d):
    """A place on the clock of run days: the day's number, and the share of its active time that is over."""
    b = segment.run_blocks(_events(s, d, "click"), "ts", GAP_S)
    rows = segment.run_columns(_events(s, d, "purchase").select("event_id", "ts"), b, "ts")
    day = b.groupBy("date").agg(F.sum("duration_s").alias("day_s"), F.min("start").alias("first"))
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)  # a row for each date
    day = day.withColumn("before", F.coalesce(F.sum("day_s").over(w), F.lit(0.0)))
    return rows.join(day, "date").select("event_id", F.round(F.col("run_day") + F.when(F.col("day_s") > 0, F.greatest(F.lit(0.0), F.col("t_active") - F.col("before")) / F.col("day_s")).otherwise(0.0), 6).alias("position"))


CLOCK_SQL = f"""
WITH b AS ({blocks_sql(GAP_S, "event_type = 'click'", '')}),
     c AS (SELECT *, coalesce(sum(duration_s) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, dense_rank() OVER (ORDER BY date) AS run_day FROM b),
     dd AS (SELECT date, min(run_day) AS run_day, sum(duration_s) AS day_s, min(before) AS day_before FROM c GROUP BY 1),
     e AS (SELECT event_id, ts, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase'),
     a AS (SELECT e.*, CASE WHEN c.start IS NULL THEN 0 ELSE c.before + (epoch_us(least(e.ts, c."end")) - epoch_us(c.start)) / 1e6 END AS t_active FROM e ASOF LEFT JOIN c ON e.ts >= c.start)
SELECT event_id, round(run_day + CASE WHEN day_s > 0 THEN greatest(0, t_active - day_before) / day_s ELSE 0 END, 6) AS position FROM a JOIN dd USING (date)"""


def rolling_windows(s, d):
    """Users with a tenth of a window's rows of one kind or more; windows are five run days."""
    day = _events(s, d).groupBy(F.to_date("ts").alias("date"), "event_type", (F.col("user_id") % 7).alias("grp")).agg(F.count("*").alias("n"))
    days = day.select("date").distinct().withColumn("run_day", F.dense_rank().over(W.orderBy("date")))  # a row for each date
    unit = day.join(days, "date").groupBy(F.floor((F.col("run_day") - 1) / 5).alias("win"), "event_type", "grp").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("win", "event_type"))
    return unit.withColumn("share", F.round(share, 6)).where(F.col("share") > 0.145).select("win", "event_type", "grp", "n", "share")


ROLLING_SQL = """
WITH x AS (SELECT CAST(ts AS DATE) AS date, event_type, user_id % 7 AS grp FROM events),
     r AS (SELECT *, dense_rank() OVER (ORDER BY date) AS run_day FROM x),
     u AS (SELECT (run_day - 1) // 5 AS win, event_type, grp, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT win, event_type, grp, n, round(n / sum(n) OVER (PARTITION BY win, event_type), 6) AS share FROM u QUALIFY share > 0.145"""


def next_block(s, d):
    """Each error's place on the next block of its date: 0 before it begins; gone after the last."""
    b = segment.run_blocks(_events(s, d, "click"), "ts", GAP_S).select("date", "block", "start", F.col("end").alias("till"))
    left = _events(s, d, "error").select("event_id", "ts", F.to_date("ts").alias("date"))
    got = asof(left, b, ["date"], "ts", "till", ["block", "start"], "forward")
    return got.where("block IS NOT NULL").select("event_id", "block", F.round(F.greatest(F.lit(0.0), (micros("ts") - micros("start")) / 1e6), 6).alias("t"))


NEXT_SQL = f"""
WITH b AS ({blocks_sql(GAP_S, "event_type = 'click'", '')}),
     l AS (SELECT event_id, ts, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error')
SELECT event_id, block, round(greatest(0, (epoch_us(ts) - epoch_us(start)) / 1e6), 6) AS t FROM l ASOF JOIN b ON l.date = b.date AND l.ts <= b."end" """


def presence(s, d):
    b = segment.run_blocks(_events(s, d, "click"), "ts", GAP_S).select("date", "block", "start", "end")
    got = asof(_events(s, d).select("user_id", "event_type", "ts", F.to_date("ts").alias("date")), b, ["date"], "ts", "start", ["block", "end"])
    return got.where("ts <= end").groupBy("date", "block", "event_type").agg(F.countDistinct("user_id").alias("n_users"))


PRESENCE_SQL = f"""
WITH b AS ({blocks_sql(GAP_S, "event_type = 'click'", '')})
SELECT b.date, b.block, event_type, count(DISTINCT user_id) AS n_users FROM events e JOIN b ON CAST(e.ts AS DATE) = b.date AND e.ts >= b.start AND e.ts <= b."end" GROUP BY 1, 2, 3"""

# ---------------------------------------------------------------- window functions

def _by():
    return W.partitionBy("user_id").orderBy("ts", "event_id")



def w01(s, d):
    return _events(s, d).select("event_id", F.lag("event_id").over(_by()).alias("last_id"), F.lead("event_id").over(_by()).alias("next_id"))


def w02(s, d):
    new = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return _events(s, d).select("event_id", F.sum(new).over(_by().rowsBetween(W.unboundedPreceding, 0)).alias("island"))


def w03(s, d):
    day = _events(s, d).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return day.select("date", F.coalesce(F.sum("n").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each date


def w04(s, d):
    days = _events(s, d).select(F.to_date("ts").alias("date")).distinct()
    return days.select("date", F.dense_rank().over(W.orderBy("date")).alias("run_day"))  # a row for each date


def w05(s, d):
    return _events(s, d).select("event_id", (F.row_number().over(_by()) - 1).alias("k"))


def w06(s, d):
    w = W.partitionBy("user_id")
    return _events(s, d, "purchase").select("event_id", F.min("value").over(w).alias("least"), F.max("value").over(w).alias("most"))


def w08(s, d):
    return _events(s, d).groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_id").alias("first_id"), F.col("m.event_type").alias("first_type"))


def w10(s, d):
    """Numbers of the runs of rows of one kind, in order."""
    new = F.when(F.lag("event_type").over(_by()) == F.col("event_type"), 0).otherwise(1)
    return _events(s, d).withColumn("new", new).select("event_id", (F.sum("new").over(_by().rowsBetween(W.unboundedPreceding, 0)) - 1).alias("run"))


def _daily(s, d):
    return _events(s, d).groupBy("event_type", F.to_date("ts").alias("date")).agg(F.sum("value").alias("x"))


def w11(s, d):
    w = W.partitionBy("event_type").orderBy("date").rowsBetween(-2, 2)
    return _daily(s, d).select("event_type", "date", F.when(F.count("x").over(w) >= 3, F.round(F.expr("percentile(x, 0.5)").over(w), 6)).alias("median"))


def w12(s, d):
    """Rows of the same kind, of the user and of others, in the 12 hours before each row."""
    span = 12 * 3600 * 1_000_000
    e = _events(s, d).withColumn("us", micros("ts"))
    own = W.partitionBy("event_type", "user_id").orderBy("us").rangeBetween(-span, -1)
    all_ = segment.recent_counts(e, ["event_type"], "event_id", "us", span, 3600 * 1_000_000)
    return e.select("event_id", F.count("*").over(own).alias("own")).join(all_, "event_id").select("event_id", "own", (F.col("n") - F.col("own")).alias("others"))


W12_SQL = """
SELECT event_id, count(*) OVER own AS own, count(*) OVER alle - count(*) OVER own AS others FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW own AS (PARTITION BY event_type, user_id ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING), alle AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND 1 PRECEDING)"""


def w14(s, d):
    """Rows whose value is over all before it of the user."""
    w = _by().rowsBetween(W.unboundedPreceding, -1)
    return _events(s, d).withColumn("best", F.max("value").over(w)).where("best IS NULL OR value > best").select("event_id", "user_id", "value")


def w15(s, d):
    """When each user's summed value first reaches half of it all."""
    run = F.sum("value").over(_by().rowsBetween(W.unboundedPreceding, 0))
    got = _events(s, d).withColumn("cum", F.round(run, 4)).withColumn("half", F.round(F.sum("value").over(W.partitionBy("user_id")) / 2, 4))
    return got.where("cum >= half").groupBy("user_id").agg(F.min("ts").alias("reached"))


def w17(s, d):
    """How many different kinds the user's last six rows had."""
    w = _by().rowsBetween(-6, -1)
    return _events(s, d).select("event_id", F.size(F.array_distinct(F.collect_list("event_type").over(w))).cast("long").alias("kinds"))


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"

QUERIES = {
    "S-01_run_blocks": (_blocks, BLOCKS_SQL),
    "S-02_main_block": (main_block, MAIN_SQL),
    "S-03_pauses": (lambda s, d: segment.pauses(_blocks(s, d), ("user_id",)), PAUSES_SQL),
    "S-04_run_columns": (run_columns, RUN_COLUMNS_SQL),
    "S-05_gap_sensitivity": (gap_sensitivity, GAP_SQL),
    "S-07_spells": (spells, SPELLS_SQL),
    "S-08_state_at": (state_at, STATE_AT_SQL),
    "S-09_open_session": (open_session, OPEN_SQL),
    "S-10_clock": (clock, CLOCK_SQL),
    "S-11_rolling_windows": (rolling_windows, ROLLING_SQL),
    "S-12_next_block": (next_block, NEXT_SQL),
    "S-13_presence": (presence, PRESENCE_SQL),
    "W-01_lag_lead": (w01, f"SELECT event_id, lag(event_id) OVER w AS last_id, lead(event_id) OVER w AS next_id FROM events {_W}"),
    "W-02_islands": (w02, "SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events"),
    "W-03_running_before": (w03, "SELECT date, CAST(coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1)"),
    "W-04_dense_rank": (w04, "SELECT DISTINCT CAST(ts AS DATE) AS date, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS INT) AS run_day FROM events"),
    "W-05_row_number": (w05, f"SELECT event_id, CAST(row_number() OVER w - 1 AS INT) AS k FROM events {_W}"),
    "W-06_group_min_max": (w06, "SELECT event_id, min(value) OVER w AS least, max(value) OVER w AS most FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id)"),
    "W-07_change_points": (spells, SPELLS_SQL),
    "W-08_first_by_order": (w08, "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1"),
    "W-10_run_ids": (w10, "SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"),
    "W-11_rolling_median": (w11, "SELECT event_type, date, CASE WHEN count(x) OVER w >= 3 THEN round(quantile_cont(x, 0.5) OVER w, 6) END AS median FROM (SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS x FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "W-12_recent_counts": (w12, W12_SQL),
    "W-14_records": (w14, "SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best"),
    "W-15_first_reach": (w15, "SELECT user_id, min(ts) AS reached FROM (SELECT user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cum, round(sum(value) OVER (PARTITION BY user_id) / 2, 4) AS half FROM events) WHERE cum >= half GROUP BY 1"),
    "W-17_lookback": (w17, "SELECT event_id, CAST(len(list_distinct(coalesce(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []))) AS BIGINT) AS kinds FROM events"),
}
