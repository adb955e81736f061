"""Queries with joins: by equality, membership, grids, as-of, windows of candidates, overlaps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.asof import asof, greedy_match, micros, window_candidates
from eventloom.operators.segment import run_blocks
from eventloom.session import table
from eventloom.shared import parts_for


def _events(s, d, kind=None):
    e = table(s, d, "events")
    return e if kind is None else e.where(F.col("event_type") == kind)


def jn01(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    got = c.select("c_custkey", "c_nationkey").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")), "c_custkey", "full")
    return got.select("c_custkey", "c_nationkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total")


def jn02(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    back = li.where("l_returnflag = 'R'").select("l_orderkey")
    late = li.where("l_shipdate > TIMESTAMP_NTZ'2000-01-01'").select("l_orderkey")
    return o.join(back, o.o_orderkey == back.l_orderkey, "left_semi").join(late, o.o_orderkey == late.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")


def jn04(s, d):
    e = _events(s, d).select(F.to_date("ts").alias("date"), "user_id")
    grid = e.select("date").distinct().crossJoin(_events(s, d).select("event_type").distinct())  # days by five kinds
    n = _events(s, d).groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count("*").alias("n"))
    return grid.join(n, ["date", "event_type"], "left").fillna(0, ["n"])


def _asof(direction, strict, tolerance=None):
    def q(s, d):
        left = _events(s, d, "purchase").select("event_id", "user_id", "ts")
        right = _events(s, d, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
        return asof(left, right, ["user_id"], "ts", "view_ts", ["view_id", "view_ts"], direction, strict, tolerance, tie="view_id")

    return q


def _asof_sql(direction, strict, tolerance=None):
    op = {("backward", False): "<=", ("backward", True): "<", ("forward", False): ">=", ("forward", True): ">"}[direction, strict]
    desc = "DESC" if direction == "backward" else ""
    within = "" if tolerance is None else f" AND abs(epoch_us(v.ts) - epoch_us(l.ts)) <= {int(tolerance * 1e6)}"
    inner = f"SELECT event_id, ts FROM events v WHERE v.event_type = 'view' AND v.user_id = l.user_id AND v.ts {op} l.ts ORDER BY v.ts {desc}, v.event_id {desc} LIMIT 1"
    return f"""
SELECT l.event_id, l.user_id, l.ts, CASE WHEN v.ts IS NOT NULL{within} THEN v.event_id END AS view_id, CASE WHEN v.ts IS NOT NULL{within} THEN v.ts END AS view_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN LATERAL ({inner}) v ON true"""


def jn10(s, d):
    left = _events(s, d, "error").select("event_id", "user_id")
    right = _events(s, d, "signup").select("user_id", F.col("event_id").alias("seq"), "value")
    return asof(left, right, ["user_id"], "event_id", "seq", ["seq", "value"], strict=True)


def jn11(s, d):
    blocks = run_blocks(_events(s, d), "ts", 3600, ("user_id",)).select("user_id", F.col("start").alias("open"), F.col("end").alias("close"))
    left = _events(s, d, "error").select("event_id", "user_id", "ts")
    got = asof(left, blocks, ["user_id"], "ts", "open", ["open", "close"])
    inside = F.col("ts") <= F.col("close")
    return got.select("event_id", "user_id", F.when(inside, F.col("open")).alias("open"), F.when(inside, F.col("close")).alias("close"))


JN11_SQL = """
WITH g AS (SELECT user_id, ts, CAST(ts AS DATE) AS date, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f
           FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts)),
     k AS (SELECT *, sum(f) OVER (PARTITION BY user_id, date ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM g),
     x AS (SELECT user_id, min(ts) AS open, max(ts) AS close FROM k GROUP BY user_id, date, b)
SELECT l.event_id, l.user_id, CASE WHEN l.ts <= x.close THEN x.open END AS open, CASE WHEN l.ts <= x.close THEN x.close END AS close
FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN x ON l.user_id = x.user_id AND l.ts >= x.open"""


def jn12(s, d):
    """The block of a row's date: the latest that has begun, else the first of the date."""
    b = run_blocks(_events(s, d, "click"), "ts", 900).select("date", "block", "start")
    left = _events(s, d, "error").select("event_id", "ts", F.to_date("ts").alias("date"))
    got = asof(left, b, ["date"], "ts", "start", ["block"])
    first = b.groupBy("date").agg(F.min("block").alias("first"))
    return got.join(first, "date", "left").select("event_id", "date", F.coalesce("block", "first").alias("block"))


JN12_SQL = """
WITH g AS (SELECT ts, CAST(ts AS DATE) AS date, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 900000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f
           FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY CAST(ts AS DATE) ORDER BY ts)),
     k AS (SELECT *, sum(f) OVER (PARTITION BY date ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM g),
     x AS (SELECT date, CAST(b AS BIGINT) AS block, min(ts) AS start FROM k GROUP BY date, b)
SELECT l.event_id, l.date, coalesce(x.block, (SELECT min(block) FROM x y WHERE y.date = l.date)) AS block
FROM (SELECT event_id, ts, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error') l ASOF LEFT JOIN x ON l.date = x.date AND l.ts >= x.start"""


def jn13(s, d):
    return window_candidates(_events(s, d, "view"), _events(s, d, "click"), ["user_id"], "event_id", "ts", "event_id", "ts", 0, 6 * 3600, 16)


JN13_SQL = """
SELECT lid, rid, dt FROM (SELECT l.event_id AS lid, r.event_id AS rid, (epoch_us(r.ts) - epoch_us(l.ts)) / 1e6 AS dt, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts, r.event_id) AS n
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'click' AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 6 HOUR) WHERE n <= 16"""


def jn14(s, d):
    """Of the first sixteen candidates of each view."""
    pairs = window_candidates(_events(s, d, "view"), _events(s, d, "click"), ["user_id"], "event_id", "ts", "event_id", "ts", 0, 6 * 3600, 16)
    return greedy_match(pairs.select("lid", "rid", F.col("dt").alias("cost")))


def jn15(s, d):
    """Distance of each customer's first and last order, as an interval of days, to marked weeks; the nearest three."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    marks = s.range(12).select(F.col("id").alias("mark"), F.date_add(F.lit("1995-02-01").cast("date"), (F.col("id") * 200).cast("int")).alias("a")).withColumn("b", F.date_add("a", 6))
    gap = F.greatest(F.lit(0), F.datediff("a", "hi"), F.datediff("lo", "b"))
    pairs = o.join(F.broadcast(marks)).withColumn("gap", gap)  # twelve marks
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("gap", F.abs(F.datediff("a", "lo")), "mark"))
    return pairs.withColumn("n", n).where("n <= 3").select("o_custkey", "mark", F.col("gap").cast("long").alias("gap"))


JN15_SQL = """
WITH o AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1),
     m AS (SELECT id AS mark, DATE '1995-02-01' + CAST(id * 200 AS INT) AS a, DATE '1995-02-01' + CAST(id * 200 + 6 AS INT) AS b FROM range(12) t(id)),
     p AS (SELECT *, greatest(0, a - hi, lo - b) AS gap FROM o, m)
SELECT o_custkey, mark, CAST(gap AS BIGINT) AS gap FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gap, abs(a - lo), mark) <= 3"""


def jn16(s, d):
    """Each date of a signup's week after, mapped to the next date with a purchase."""
    days = _events(s, d, "purchase").select(F.to_date("ts").alias("day")).distinct().withColumn("one", F.lit(1))
    left = _events(s, d, "signup").select("event_id", F.date_add(F.to_date("ts"), 7).alias("due"))
    # Dates are as many as the calendar has, so they are looked up once each, and joined back by equality.
    dates = asof(left.select("due", F.lit(1).alias("one")).distinct(), days, ["one"], "due", "day", ["day"], "forward")
    return left.join(dates.select("due", "day"), "due", "left").select("event_id", "due", "day")


JN16_SQL = """
WITH x AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
     l AS (SELECT event_id, CAST(ts AS DATE) + 7 AS due FROM events WHERE event_type = 'signup')
SELECT event_id, due, (SELECT min(day) FROM x WHERE day >= due) AS day FROM l"""


def jn18(s, d):
    """Rows inside a spell of their user: spells last from a signup until the second purchase after."""
    e = _events(s, d)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    spells = e.where("event_type IN ('signup', 'purchase')").withColumn("b", F.lead("ts", 2).over(w)).where("event_type = 'signup' AND b IS NOT NULL").select("user_id", F.col("ts").alias("a"), "b")
    rows = e.where("event_type = 'error'")
    hit = rows.join(spells, "user_id").where("a <= ts AND ts < b").groupBy("event_id").agg(F.count("*").alias("n"))
    return rows.join(hit, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n_spells"))


JN18_SQL = """
WITH sp AS (SELECT user_id, ts AS a, b FROM (SELECT *, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type IN ('signup', 'purchase')) WHERE event_type = 'signup' AND b IS NOT NULL)
SELECT e.event_id, count(sp.a) AS n_spells FROM events e LEFT JOIN sp ON e.user_id = sp.user_id AND sp.a <= e.ts AND e.ts < sp.b WHERE e.event_type = 'error' GROUP BY e.event_id"""


def jn19(s, d):
    """Users active in a day's first and last hour alike: existence of overlapping spells."""
    b = run_blocks(_events(s, d), "ts", 3600, ("user_id",))
    busy = b.where("n_rows >= 2").select("user_id", "date", "start", "end")
    calls = _events(s, d, "error").select("event_id", "user_id", F.to_date("ts").alias("date"), "ts")
    hit = calls.join(busy, ["user_id", "date"]).where((F.col("start") <= F.col("ts")) & (F.col("ts") <= F.col("end"))).select("event_id").distinct()
    return calls.join(hit, "event_id", "left_semi").select("event_id", "user_id")


JN19_SQL = JN11_SQL.split("SELECT l.event_id")[0].replace("min(ts) AS open, max(ts) AS close", "date, count(*) AS n, min(ts) AS open, max(ts) AS close") + """
SELECT event_id, user_id FROM events e WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM x WHERE n >= 2 AND x.user_id = e.user_id AND x.date = CAST(e.ts AS DATE) AND x.open <= e.ts AND e.ts <= x.close)"""


def jn20(s, d):
    """Rows of the same user within two hours of an error."""
    h = 7200
    e = _events(s, d)
    got = window_candidates(e.where("event_type = 'error'"), e, ["user_id"], "event_id", "ts", "event_id", "ts", -h, h, 1 << 30)
    return got.where("lid <> rid").groupBy("lid").agg(F.count("*").alias("n_near"), F.round(F.max(F.abs("dt")), 6).alias("farthest"))


JN20_SQL = """
SELECT l.event_id AS lid, count(*) AS n_near, round(max(abs(epoch_us(r.ts) - epoch_us(l.ts)) / 1e6), 6) AS farthest
FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_id <> r.event_id AND l.event_type = 'error' AND abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 7200000000 GROUP BY 1"""


def jn22(s, d):
    b = run_blocks(_events(s, d), "ts", 3600, ("user_id",))
    w = W.partitionBy("user_id").orderBy("start")
    return b.select("user_id", "start", F.lag("end").over(w).alias("last_end"), F.round((micros("start") - micros(F.lag("end").over(w))) / 1e6, 6).alias("away_s"))


JN22_SQL = JN11_SQL.split("SELECT l.event_id")[0] + """
SELECT user_id, open AS start, lag(close) OVER w AS last_end, round((epoch_us(open) - epoch_us(lag(close) OVER w)) / 1e6, 6) AS away_s FROM x WINDOW w AS (PARTITION BY user_id ORDER BY open)"""


def jn23(s, d):
    """For each error, how many of the user's last 50 rows were clicks, and how far back the latest was."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-50, -1)
    back = F.collect_list(F.struct("event_type", "ts")).over(w)
    got = _events(s, d).withColumn("back", back).where("event_type = 'error'")
    clicks = F.filter("back", lambda x: x["event_type"] == "click")
    return got.select("event_id", F.size(clicks).cast("long").alias("n_clicks"), F.array_max(F.transform(clicks, lambda x: x["ts"])).alias("last_click"))


JN23_SQL = """
SELECT event_id, n_clicks, last_click FROM (SELECT event_id, event_type, count(*) FILTER (event_type = 'click') OVER w AS n_clicks, max(ts) FILTER (event_type = 'click') OVER w AS last_click
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) WHERE event_type = 'error'"""


#: Of a part, orders that are paired with one order in one row.
PAIRED = 1 << 8


def jn24(s, d):
    """How many parts two suppliers of one order have in common with each other's orders: shared parts of order pairs by part."""
    li = table(s, d, "lineitem")
    parts = parts_for(li.count())  # of the files' footers
    li = li.select(F.col("l_partkey").cast("long").alias("part"), F.col("l_orderkey").cast("long").alias("x")).where("part IS NOT NULL AND x IS NOT NULL")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each order of a part with those after it, as lists; rows come by part and order. A part's orders are held, no pairs are.
        held, of, size, rows = [], None, 0, []

        def lists(y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for i in range(len(y) - 1):
                for k in range(i + 1, len(y), PAIRED):
                    yield int(y[i]), y[k : k + PAIRED]

        def sent(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[1]) for r in rows)]), pa.int32()), pa.array(np.concatenate([r[1] for r in rows]), pa.int64()))], names=["x", "ys"])

        def ended(last: bool) -> Iterator[list]:
            nonlocal rows, size
            for r in lists(np.concatenate(held)) if held else ():
                rows.append(r)
                size += len(r[1])
                if size >= 1 << 17:
                    yield rows
                    rows, size = [], 0
            if last and rows:
                yield rows

        for batch in batches:
            p, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(p):
                continue
            for a, b in itertools.pairwise([0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]):
                if of != p[a]:
                    for r in ended(False):
                        yield sent(r)
                    held, of = [], p[a]
                held.append(x[a:b])
        for r in ended(True):
            yield sent(r)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by order; what a batch's last order has waits for the next.
        x, y = np.empty(0, np.int64), np.empty(0, np.int64)

        def counted(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            o = np.lexsort((y, x))
            x, y = x[o], y[o]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(x)])
            for k in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)]) for v in (x[first], y[first], n)], names=["x", "y", "n_shared"])

        for batch in batches:
            ys = batch.column(1)
            x = np.r_[x, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), ys.value_lengths().to_numpy(zero_copy_only=False))]
            y = np.r_[y, ys.flatten().to_numpy(zero_copy_only=False)]
            if len(x) > 1 << 17 and x[0] != x[-1]:
                k = int(np.searchsorted(x, x[-1]))
                yield from counted(x[:k], y[:k])
                x, y = x[k:], y[k:]
        yield from counted(x, y)

    by_part = li.repartition(parts, "part").distinct().sortWithinPartitions("part", "x")
    lists = by_part.mapInArrow(pairs, "x long, ys array<long>")
    # A pair costs 8 bytes here, and an order's pairs meet in one task without a table of them.
    return lists.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(counts, "x long, y long, n_shared long")


JN24_SQL = """
WITH li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS n_shared FROM li a JOIN li b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2"""


def jn25(s, d):
    """Parts that are sold by exactly the same suppliers, under the least of them."""
    li = table(s, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("who"))
    return li.groupBy("who").agg(F.min("l_partkey").alias("part"), F.count("*").alias("n")).select("part", "n", F.size("who").cast("long").alias("n_who"))


JN25_SQL = """
WITH p AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS who FROM lineitem GROUP BY 1)
SELECT min(l_partkey) AS part, count(*) AS n, CAST(len(who) AS BIGINT) AS n_who FROM p GROUP BY who"""


def jn26(s, d):
    """Each customer's usual priority: with two orders or more, and half of them at least."""
    n = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = n.groupBy("o_custkey").agg(F.max(F.struct("n", F.col("o_orderpriority").alias("p"))).alias("m"), F.sum("n").alias("total"))
    return best.where("m.n >= 2 AND 2 * m.n >= total").select("o_custkey", F.col("m.p").alias("priority"), F.col("m.n").alias("votes"))


JN26_SQL = """
WITH n AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2),
     r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p DESC) AS k FROM n)
SELECT o_custkey, p AS priority, n AS votes FROM r WHERE k = 1 AND n >= 2 AND 2 * n >= total"""


def jn27(s, d):
    """Labels to names: equal, else the only name that begins so, whatever the case."""
    names = table(s, d, "nation").select("n_nationkey", "n_name")
    labels = names.select(F.col("n_nationkey").alias("label_id"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.lower(F.substring("n_name", 1, 7))).alias("label"))
    exact = labels.join(names, F.col("label") == F.col("n_name")).select("label_id", "n_nationkey")
    part = labels.join(exact, "label_id", "left_anti").join(F.broadcast(names), F.lower("n_name").startswith(F.lower("label"))).groupBy("label_id").agg(F.count("*").alias("n"), F.min("n_nationkey").alias("n_nationkey")).where("n = 1").select("label_id", "n_nationkey")
    return labels.join(exact.unionByName(part), "label_id", "left").select("label_id", "label", "n_nationkey")


JN27_SQL = """
WITH l AS (SELECT n_nationkey AS label_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(substr(n_name, 1, 7)) END AS label FROM nation),
     x AS (SELECT label_id, n_nationkey FROM l JOIN nation ON label = n_name),
     p AS (SELECT label_id, min(n_nationkey) AS n_nationkey FROM l JOIN nation ON starts_with(lower(n_name), lower(label)) WHERE label_id NOT IN (SELECT label_id FROM x) GROUP BY 1 HAVING count(*) = 1)
SELECT label_id, label, n_nationkey FROM l LEFT JOIN (FROM x UNION ALL FROM p) USING (label_id)"""


def jn28(s, d):
    """Days and the kinds seen on them, as a list and taken apart again."""
    days = _events(s, d).groupBy(F.to_date("ts").alias("date"), "user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))
    return days.select("date", F.explode(F.split("kinds", ";")).alias("kind")).groupBy("date", "kind").agg(F.count("*").alias("n_users"))


JN28_SQL = "SELECT CAST(ts AS DATE) AS date, event_type AS kind, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2"


def jn05(s, d):
    """For each signup, a mask of kinds whose latest row of that user came before it (as-of for each kind, as bits)."""
    kinds = ["click", "error", "purchase", "view"]
    left = _events(s, d, "signup").select("event_id", "user_id", "ts")
    grid = left.crossJoin(F.broadcast(s.createDataFrame(list(enumerate(kinds)), "bit int, kind string")))  # four kinds
    right = _events(s, d).select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    got = asof(grid, right, ["user_id", "kind"], "ts", "at", ["at"], strict=True)
    return got.groupBy("event_id").agg(F.bit_or(F.when(F.col("at").isNotNull(), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))).alias("mask"))


JN05_SQL = """
SELECT l.event_id, CAST(coalesce(bit_or(CASE r.event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'view' THEN 8 ELSE 0 END), 0) AS BIGINT) AS mask
FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.ts < l.ts WHERE l.event_type = 'signup' GROUP BY 1"""


QUERIES = {
    "JN-01_full_join": (jn01, "SELECT c_custkey, c_nationkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 UNION ALL SELECT o_custkey, NULL, count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1"),
    "JN-02_semi_anti": (jn02, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01')"),
    "JN-03_membership": (lambda s, d: table(s, d, "lineitem").join(table(s, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts")), "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) AND l_returnflag IN ('A', 'R') GROUP BY 1"),
    "JN-04_grid": (jn04, "SELECT date, event_type, count(e.event_id) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events) LEFT JOIN (SELECT CAST(ts AS DATE) AS date, event_type, event_id FROM events) e USING (date, event_type) GROUP BY 1, 2"),
    "JN-05_visibility_mask": (jn05, JN05_SQL),
    "JN-06_asof_backward": (_asof("backward", False), _asof_sql("backward", False)),
    "JN-07_asof_strict": (_asof("backward", True), _asof_sql("backward", True)),
    "JN-08_asof_forward": (_asof("forward", False), _asof_sql("forward", False)),
    "JN-08_asof_forward_strict": (_asof("forward", True), _asof_sql("forward", True)),
    "JN-09_asof_tolerance": (_asof("forward", False, 36000), _asof_sql("forward", False, 36000)),
    "JN-10_asof_sequence": (jn10, "SELECT l.event_id, l.user_id, r.event_id AS seq, r.value FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.event_id > r.event_id"),
    "JN-11_asof_valid": (jn11, JN11_SQL),
    "JN-12_asof_fallback": (jn12, JN12_SQL),
    "JN-13_window_candidates": (jn13, JN13_SQL),
    "JN-14_greedy_match": (jn14, None),
    "JN-15_interval_gap": (jn15, JN15_SQL),
    "JN-16_next_day": (jn16, JN16_SQL),
    "JN-18_spell_membership": (jn18, JN18_SQL),
    "JN-19_overlap_exists": (jn19, JN19_SQL),
    "JN-20_window_hits": (jn20, JN20_SQL),
    "JN-22_previous_row": (jn22, JN22_SQL),
    "JN-23_lookback": (jn23, JN23_SQL),
    "JN-24_shared_counts": (jn24, JN24_SQL),
    "JN-25_same_set": (jn25, JN25_SQL),
    "JN-26_majority": (jn26, JN26_SQL),
    "JN-27_name_lookup": (jn27, JN27_SQL),
    "JN-28_list_links": (jn28, JN28_SQL),
}
