"""Queries of the analytic modules: excitation, survival, transmission, change points, graphs, simulation, validation."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import excite, graph, resample, shift, stats, survive, swarm, transmit
from eventloom.operators.asof import micros
from eventloom.session import table
from eventloom.shared import materialize, parts_for, shared_dir
from eventloom.sources import jsonl
from eventloom.streaming import live

R = 6
REACH, BETAS, WEIGHTS = 6 * 3600.0, [1 / 600, 1 / 3600], [0.4, 0.6]
MU = 2e-6


def _events(s, d):
    return table(s, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("i"), "value", (micros("ts") / 1e6).alias("t"))


def _pairs(s, d):
    return excite.pairs(_events(s, d), "user_id", "event_id", "t", "i", REACH)


PAIRS = f"""
SELECT c.user_id, c.event_id AS target, p.event_id AS source, c.event_type AS i, p.event_type AS j, epoch_us(c.ts) / 1e6 - epoch_us(p.ts) / 1e6 AS dt
FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts < c.ts AND epoch_us(c.ts) / 1e6 - epoch_us(p.ts) / 1e6 <= {REACH}"""
KERNEL = " + ".join(f"{w * b!r} * exp(-{b!r} * dt)" for b, w in zip(BETAS, WEIGHTS))


def _posterior(s, d):
    alpha = F.when(F.col("i") == F.col("j"), 0.3).otherwise(0.1)
    return excite.posterior(_pairs(s, d), _events(s, d), "event_id", alpha, F.lit(MU), BETAS, WEIGHTS)


POSTERIOR = f"""
SELECT target, source, i, j, v / sum(v) OVER (PARTITION BY target) AS prob FROM (
  SELECT target, source, i, j, CASE WHEN i = j THEN 0.3 ELSE 0.1 END * ({KERNEL}) AS v FROM ({PAIRS})
  UNION ALL SELECT event_id, NULL, event_type, NULL, {MU!r} FROM events) QUALIFY prob >= 0.01"""


def ex02(s, d):
    e = _events(s, d).withColumn("t0", F.col("t") - F.unix_date(F.to_date("ts")) * 86400)
    return excite.exposure(e, "user_id", "t0", "i", F.lit(86400.0), BETAS, REACH).select("j", F.round("g0", 4).alias("g0"), F.round("g1", 4).alias("g1"))


EX02 = "SELECT event_type AS j, " + ", ".join(f"round(sum(1 - exp(-{b!r} * least({REACH}, 86400 - (epoch_us(ts) / 1e6 - epoch_us(date_trunc('day', ts)) / 1e6)))), 4) AS g{m}" for m, b in enumerate(BETAS)) + " FROM events GROUP BY 1"


def ex03(s, d):
    """Log-likelihood terms of each type at fixed parameters."""
    alpha = F.when(F.col("i") == F.col("j"), 0.3).otherwise(0.1)
    v = _pairs(s, d).groupBy("target").agg(F.sum(alpha * excite.kernel(F.col("dt"), BETAS, WEIGHTS)).alias("v"))
    e = _events(s, d).select(F.col("event_id").alias("target"), "i").join(v, "target", "left")
    return e.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum(F.log(MU + F.coalesce("v", F.lit(0.0)))), 3).alias("sum_log"))


EX03 = f"""
WITH v AS (SELECT target, sum(CASE WHEN i = j THEN 0.3 ELSE 0.1 END * ({KERNEL})) AS v FROM ({PAIRS}) GROUP BY 1)
SELECT event_type AS i, count(*) AS n, round(sum(ln({MU!r} + coalesce(v, 0))), 3) AS sum_log FROM events LEFT JOIN v ON event_id = target GROUP BY 1"""


def ex07(s, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = _events(s, d).select(F.unix_date(F.to_date("ts")).alias("day"), (F.col("t") - F.unix_date(F.to_date("ts")) * 86400).alias("t"), (F.array_position(F.array(*map(F.lit, kinds)), F.col("i")) - 1).alias("k"))
    return excite.fit_windows(e, "day", "t", "k", len(kinds), 86400.0, BETAS, 3600.0)


def ex12(s, d):
    """Simulated realizations, with the share of events that have a parent of their own kind."""

    def run(batches):
        mu, n = np.array([2.0, 1.0]), np.array([[0.4, 0.1], [0.2, 0.3]])
        for pdf in batches:
            rows = []
            for rep in pdf["id"]:
                t, kind, parent = excite.simulate(np.random.default_rng([5, int(rep)]), mu, n, 1.0, 50.0)
                own = parent >= 0
                rows.append((int(rep), len(t), float(own.mean()), float((kind[own] == kind[parent[own]]).mean()) if own.any() else 0.0))
            yield pd.DataFrame(rows, columns=["rep", "n", "with_parent", "own_kind"])

    return s.range(64).mapInPandas(run, "rep long, n long, with_parent double, own_kind double")


def ex13(s, d):
    """Gaps between a kind's rows, as multiples of their mean, against the exponential."""

    def run(pdf):
        g = np.diff(np.sort(pdf["t"].to_numpy()))
        dist, p = excite.ks_exponential(g / g.mean() if len(g) else g)
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "n": [len(g)], "distance": [dist], "p": [p]})

    # A kind and day is one group: as many rows as a day has.
    e = _events(s, d).withColumn("day", F.to_date("ts"))
    return e.select("i", "day", "t").groupBy("i", "day").applyInPandas(lambda pdf: run(pdf).assign(day=pdf["day"].iloc[0]), "i string, n long, distance double, p double, day date")


def ex20(s, d):
    p = _posterior(s, d).withColumn("prob", F.round("prob", 9))
    return p.groupBy("target").agg(F.max(F.struct("prob", F.coalesce("source", F.lit(-1)).alias("source"))).alias("m")).select("target", F.col("m.source").alias("parent"), F.round("m.prob", R).alias("prob"))


EX20 = f"SELECT target, parent, round(prob, 6) AS prob FROM (SELECT target, coalesce(source, -1) AS parent, round(prob, 9) AS prob FROM ({POSTERIOR})) QUALIFY row_number() OVER (PARTITION BY target ORDER BY prob DESC, parent DESC) = 1"

# ---------------------------------------------------------------- survival


def sv01(s, d):
    """Documents of a source as versions of one text."""
    return survive.relations(table(s, d, "documents"), "source", "doc_id", "text").select(F.col("id").alias("doc_id"), "rel", "base", F.col("base_lag").cast("long").alias("base_lag"))


RELATIONS = """
     v AS (SELECT doc_id, source, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
     b AS (SELECT a.doc_id, max(b.k) FILTER (b.k = a.k - 1) AS p, bool_or(b.k = a.k - 1 AND b.t = a.t) AS ident, bool_or(b.k = a.k - 1 AND b.n < a.n AND starts_with(a.t, b.t)) AS append,
                  max(b.k) FILTER (b.k BETWEEN a.k - 6 AND a.k - 2 AND b.t = a.t) AS undone, bool_or(b.k = a.k - 1 AND a.n < b.n AND starts_with(b.t, a.t)) AS trunc,
                  max(b.k) FILTER (b.k BETWEEN a.k - 50 AND a.k - 2 AND b.n > 0 AND b.n < a.n AND starts_with(a.t, b.t)) AS forked
           FROM v a JOIN v b ON a.source IS NOT DISTINCT FROM b.source AND b.k BETWEEN a.k - 50 AND a.k - 1 GROUP BY 1),
     q AS (SELECT v.doc_id, v.source, v.k, CASE WHEN p IS NULL THEN 'first' WHEN ident THEN 'ident' WHEN append THEN 'append' WHEN undone IS NOT NULL THEN 'revert' WHEN trunc THEN 'trunc' WHEN forked IS NOT NULL THEN 'fork' ELSE 'rewrite' END AS rel,
                  CASE WHEN ident OR append THEN p WHEN undone IS NOT NULL THEN undone WHEN trunc THEN p WHEN forked IS NOT NULL THEN forked ELSE p END AS at FROM v LEFT JOIN b USING (doc_id)),
     r AS (SELECT q.doc_id, q.source, q.k, q.rel, o.doc_id AS base, q.k - q.at AS base_lag, z.doc_id AS prev FROM q LEFT JOIN v o ON q.source IS NOT DISTINCT FROM o.source AND o.k = q.at LEFT JOIN v z ON q.source IS NOT DISTINCT FROM z.source AND z.k = q.k - 1)"""
SV01 = f"WITH {RELATIONS}\nSELECT doc_id, rel, base, base_lag FROM r"
LINEAGE = f"""WITH RECURSIVE {RELATIONS},
     g AS (SELECT doc_id, doc_id AS gen FROM r WHERE rel IN ('first', 'rewrite') UNION ALL SELECT r.doc_id, g.gen FROM r JOIN g ON r.base = g.doc_id WHERE rel NOT IN ('first', 'rewrite')),
     i AS (SELECT doc_id, doc_id AS input FROM r WHERE rel <> 'ident' UNION ALL SELECT r.doc_id, i.input FROM r JOIN i ON r.base = i.doc_id WHERE rel = 'ident'),
     t AS (SELECT r.doc_id, i.input, g.gen AS parent FROM r LEFT JOIN i ON i.doc_id = r.prev AND r.rel = 'rewrite' LEFT JOIN g ON g.doc_id = i.input WHERE rel IN ('first', 'rewrite')),
     e AS (SELECT doc_id, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.doc_id, e.depth + 1 FROM t JOIN e ON t.parent = e.doc_id),
     l AS (SELECT r.*, g.gen, CAST(e.depth AS BIGINT) AS depth, t.parent, t.input FROM r JOIN g USING (doc_id) JOIN e ON e.doc_id = g.gen LEFT JOIN t ON t.doc_id = r.doc_id)"""


def _days(s, d):
    return table(s, d, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))


def sv08(s, d):
    return survive.presence_spells(_days(s, d), ["user_id"], "day")


SV08 = """
WITH x AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day FROM events),
     g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM x),
     r AS (SELECT user_id, min(day) AS start, max(day) AS "end" FROM g GROUP BY user_id, i)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start) AS INT) AS spell, start, "end" FROM r"""


def _risk(s, d):
    u = sv08(s, d).select((F.col("user_id") % 3).alias("grp"), (F.col("end") - F.col("start") + 1).alias("last"), (F.col("end") < 29).alias("lost"))
    return survive.risk_counts(u, ["grp"], "last", "lost")


RISK = f"""
WITH u AS (SELECT user_id % 3 AS grp, "end" - start + 1 AS last, "end" < 29 AS lost FROM ({SV08})),
     g AS (SELECT DISTINCT grp, last AS g FROM u UNION SELECT DISTINCT grp, last + 1 FROM u UNION SELECT DISTINCT grp, 1 FROM u),
     r AS (SELECT g.grp, CAST(g.g AS BIGINT) AS g, count(*) FILTER (u.last >= g.g) AS at_risk, count(*) FILTER (u.last = g.g AND u.lost) AS lost FROM g JOIN u USING (grp) GROUP BY 1, 2 HAVING count(*) FILTER (u.last >= g.g) > 0)"""


def sv09(s, d):
    return survive.hazards(_risk(s, d), ["grp"]).select("grp", "g", F.round("hazard", R).alias("hazard"), F.round("survival", R).alias("survival"))


SV09 = RISK + """
SELECT grp, g, round(lost / at_risk, 6) AS hazard, round(CASE WHEN max(CAST(lost = at_risk AS INT)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN lost < at_risk THEN ln(1 - lost / at_risk) ELSE 0 END) OVER w) END, 6) AS survival
FROM r WINDOW w AS (PARTITION BY grp ORDER BY g ROWS UNBOUNDED PRECEDING)"""


def sv10(s, d):
    """Log-likelihoods of one hazard for all trials, and of one for each trial."""
    r = _risk(s, d)
    one = r.groupBy("grp").agg((F.sum("lost") / F.sum("at_risk")).alias("p"))
    xl = lambda n, p: F.when((n > 0) & (p > 0), n * F.log(p)).otherwise(0.0)
    q = r.join(one, "grp").withColumn("h", F.col("lost") / F.col("at_risk"))
    return q.groupBy("grp").agg(F.round(F.sum(xl(F.col("lost"), F.col("p")) + xl(F.col("at_risk") - F.col("lost"), 1 - F.col("p"))), 4).alias("geometric"), F.round(F.sum(xl(F.col("lost"), F.col("h")) + xl(F.col("at_risk") - F.col("lost"), 1 - F.col("h"))), 4).alias("piecewise"))


SV10 = RISK + """,
     q AS (SELECT *, lost / at_risk AS h, sum(lost) OVER (PARTITION BY grp) / sum(at_risk) OVER (PARTITION BY grp) AS p FROM r)
SELECT grp, round(sum(CASE WHEN lost > 0 THEN lost * ln(p) ELSE 0 END + CASE WHEN at_risk > lost THEN (at_risk - lost) * ln(1 - p) ELSE 0 END), 4) AS geometric,
       round(sum(CASE WHEN lost > 0 THEN lost * ln(h) ELSE 0 END + CASE WHEN at_risk > lost THEN (at_risk - lost) * ln(1 - h) ELSE 0 END), 4) AS piecewise FROM q GROUP BY 1"""

# ---------------------------------------------------------------- transmission


def _occ(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_partkey").alias("unit"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ"), F.col("l_suppkey").alias("actor"), F.datediff("l_shipdate", F.lit("1995-01-01")).alias("day")).distinct()


def _cand(s, d):
    return transmit.candidates(_occ(s, d), "unit", "occ", "day", "actor", 20)


CAND = """
WITH o AS (SELECT DISTINCT l_partkey AS unit, l_orderkey * 10 + l_linenumber AS occ, l_suppkey AS actor, CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS INT) AS day FROM lineitem),
     c AS (SELECT a.unit, a.occ AS child, b.occ AS parent, a.day - b.day AS dt FROM o a JOIN o b ON a.unit = b.unit AND b.day < a.day AND b.day >= a.day - 20 AND a.actor <> b.actor)"""


def _post(s, d):
    return transmit.softmax(_cand(s, d), -F.log(F.col("dt").cast("double")) - 0.1 * F.col("dt"))


POST = CAND + ",\n     p AS (SELECT *, exp(-ln(dt) - 0.1 * dt) / sum(exp(-ln(dt) - 0.1 * dt)) OVER (PARTITION BY child) AS post FROM c)"
MAP = POST + ",\n     m AS (SELECT child, max(parent) AS parent, max(post) AS post FROM (SELECT *, max(post) OVER (PARTITION BY child) AS t FROM p) WHERE post >= t - 1e-12 GROUP BY 1)"


def _best(s, d):
    """(unit, child, parent, dt, post, n) of the likeliest parents, written once."""
    return materialize(transmit.likeliest_rows(_post(s, d)), "likeliest")


def _forest(s, d, best):
    up = best.groupBy("child").agg(F.max("parent").alias("parent"))
    nodes = _occ(s, d).select(F.col("occ").alias("child")).distinct().join(up, "child", "left").select("child", "parent")
    return graph.forest(nodes, "child", "parent")


def tr14(s, d):
    return _forest(s, d, _best(s, d))


TR14 = MAP.replace("WITH o AS", "WITH RECURSIVE o AS") + """,
     n AS (SELECT DISTINCT occ AS child, parent FROM o LEFT JOIN m ON m.child = o.occ),
     f AS (SELECT child AS node, child AS root, 0 AS generation FROM n WHERE parent IS NULL UNION ALL SELECT n.child, f.root, f.generation + 1 FROM n JOIN f ON n.parent = f.node)
SELECT node, root, CAST(generation AS BIGINT) AS generation FROM f"""


def tr20(s, d):
    """Spearman correlation of a transmission's interval and the next, over edges of the likeliest forest."""
    best = _best(s, d).select("child", "parent", "dt")
    up = best.select(F.col("child").alias("parent"), F.col("dt").alias("dt_up"))
    e = best.join(up, "parent")
    # Ranks come from the counts of pairs of intervals, of which there are as many as days in reach, squared.
    n = materialize(e.groupBy("dt", "dt_up").agg(F.count("*").alias("n")), "intervals")
    out = n
    for c in ("dt", "dt_up"):
        own = n.groupBy(c).agg(F.sum("n").alias("m"))
        r = own.select(c, (F.sum("m").over(W.orderBy(c).rowsBetween(W.unboundedPreceding, 0)) - (F.col("m") - 1) / 2).alias(f"r_{c}"))
        out = out.join(F.broadcast(r), c)  # as many rows as days in reach
    # Ranks less their mean, so that large ones lose no digits.
    mid = (F.sum("n").over(W.partitionBy()) + 1) / 2  # as many rows as pairs of days
    out = out.withColumn("x", F.col("r_dt") - mid).withColumn("y", F.col("r_dt_up") - mid)
    xy, xx, yy = (F.sum(F.col("n") * F.col(u) * F.col(v)) for u, v in ("xy", "xx", "yy"))
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)), R).alias("spearman"))


TR20 = MAP + """,
     b AS (SELECT m.child, m.parent, c.dt FROM m JOIN c USING (child, parent)),
     e AS (SELECT b.dt, u.dt AS dt_up FROM b JOIN b u ON u.child = b.parent),
     r AS (SELECT rank() OVER (ORDER BY dt) + (count(*) OVER (PARTITION BY dt) - 1) / 2 AS a, rank() OVER (ORDER BY dt_up) + (count(*) OVER (PARTITION BY dt_up) - 1) / 2 AS b FROM e)
SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r"""


def tr22(s, d):
    """Type-token ratio of turns, and Jaccard overlap with the turn before."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    c = table(s, d, "conversations").withColumn("w", w)
    p = F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))
    inter, union = F.size(F.array_intersect("w", "p")), F.size(F.array_union("w", "p"))
    return c.withColumn("p", p).select("conv_id", "turn", F.round(F.size(F.array_distinct("w")) / F.size("w"), R).alias("ttr"), F.when(F.col("p").isNotNull() & (union > 0), F.round(inter / union, R)).alias("jaccard"))


TR22 = """
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
SELECT conv_id, turn, round(len(list_distinct(w)) / nullif(len(w), 0), 6) AS ttr, CASE WHEN p IS NOT NULL AND len(list_distinct(w || p)) > 0 THEN round(len(list_intersect(list_distinct(w), list_distinct(p))) / len(list_distinct(w || p)), 6) END AS jaccard FROM p"""


def tr24(s, d):
    """How many of ten groups of suppliers had sold a part before each day it was sold on."""
    o = _occ(s, d).groupBy("unit", "day").agg(F.bit_or(F.expr("shiftleft(1L, CAST(actor % 10 AS INT))")).alias("m"))
    # A running union of bits: one running maximum for each bit.
    w = W.partitionBy("unit").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    seen = sum((F.coalesce(F.max(F.getbit("m", F.lit(b))).over(w).cast("int"), F.lit(0)) for b in range(10)), F.lit(0))
    return o.select("unit", "day", seen.alias("n_seen"))


TR24 = CAND.split(",\n     c AS")[0] + """
SELECT unit, day, CAST(coalesce(bit_count(bit_or(m) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS INT) AS n_seen
FROM (SELECT unit, day, bit_or(1 << CAST(actor % 10 AS INT)) AS m FROM o GROUP BY 1, 2)"""


def tr18(s, d):
    li = table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_discount").alias("num"), F.count("*").cast("double").alias("den"))
    got = resample.bootstrap_ratio(li, ["l_returnflag"], "l_suppkey", "num", "den", 200)
    return got.select("l_returnflag", *(F.round(c, R).alias(c) for c in ("ratio", "lo", "hi")))


TR18 = f"""
WITH c AS (SELECT l_returnflag, l_suppkey, sum(l_discount) AS num, count(*) AS den FROM lineitem GROUP BY 1, 2),
     w AS (SELECT c.*, rep, {resample.poisson1_sql(resample.unit_sql(1, "rep", "l_suppkey"))} AS w FROM c, range(200) t(rep)),
     b AS (SELECT l_returnflag, rep, sum(w * num) / sum(w * den) AS r FROM w GROUP BY 1, 2)
SELECT l_returnflag, round(any_value(ratio), 6) AS ratio, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM b JOIN (SELECT l_returnflag, sum(num) / sum(den) AS ratio FROM c GROUP BY 1) USING (l_returnflag) GROUP BY 1"""


def tr17(s, d):
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n")), "doc_id")
    got = resample.permutation_test(x.select("doc_id", "lang", "quality", "n"), "lang", "quality", "n", "doc_id", 99)
    return got.select(F.round("diff", R).alias("diff"), F.round("p", R).alias("p"))


TR17 = f"""
WITH x AS (SELECT doc_id, lang, quality, n_chars AS n FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, sum(quality) AS n1 FROM x GROUP BY 1),
     d AS (SELECT rep, n, row_number() OVER (PARTITION BY rep, lang ORDER BY {resample.unit_sql(2, "rep", "doc_id")}, doc_id) <= n1 AS one FROM x JOIN c USING (lang), range(99) t(rep)),
     u AS (SELECT rep, avg(n) FILTER (one) - avg(n) FILTER (NOT one) AS d FROM d GROUP BY 1), o AS (SELECT avg(n) FILTER (quality = 1) - avg(n) FILTER (quality = 0) AS diff FROM x)
SELECT round(diff, 6) AS diff, round((1 + count(*) FILTER (abs(d) >= abs(diff))) / (1 + count(*)), 6) AS p FROM u, o GROUP BY o.diff"""


# ---------------------------------------------------------------- change points


def _series(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("series"), F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.count("*").cast("double").alias("x"))


def cp01(s, d):
    return shift.noise_scale(_series(s, d), ["series"], "day", "x").select("series", F.round("sigma", R).alias("sigma"))


CP01 = """
WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2),
     dd AS (SELECT series, x - lag(x) OVER (PARTITION BY series ORDER BY day) AS d FROM x),
     m AS (SELECT series, quantile_cont(d, 0.5) AS m, stddev_pop(d) AS sd FROM dd WHERE d IS NOT NULL GROUP BY 1),
     a AS (SELECT series, quantile_cont(abs(d - m), 0.5) AS mad, any_value(sd) AS sd FROM dd JOIN m USING (series) WHERE d IS NOT NULL GROUP BY 1)
SELECT series, round(CASE WHEN mad > 0 THEN mad / 0.67449 / sqrt(2) ELSE sd / sqrt(2) END, 6) AS sigma FROM a"""


def _points(s, d):
    """Days on which a kind's count jumps by a fifth."""
    w = W.partitionBy("series").orderBy("day")
    return _series(s, d).withColumn("p", F.lag("x").over(w)).where("abs(x - p) > 0.2 * p").select(F.col("day").alias("at"))


def _entries(s):
    return s.range(4).select((F.col("id") * 7 + 2).cast("int").alias("lo"), (F.col("id") * 7 + 2 + F.col("id") % 2).cast("int").alias("hi"))


POINTS = """
WITH x AS (SELECT event_type AS series, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day, count(*) AS x FROM events GROUP BY 1, 2),
     pt AS (SELECT day AS at FROM (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY day) AS p FROM x) WHERE abs(x - p) > 0.2 * p),
     en AS (SELECT id * 7 + 2 AS lo, id * 7 + 2 + id % 2 AS hi FROM range(4) t(id))"""
CP11 = POINTS + """,
     dy AS (SELECT DISTINCT unnest(range(lo - 1, hi + 2)) AS day FROM en), o AS (SELECT o FROM range(3, 28) t(o)),
     mv AS (SELECT DISTINCT o, ((day + o) % 30 + 30) % 30 AS at FROM dy, o)
SELECT o AS "offset", count(pt.at) AS s FROM mv LEFT JOIN pt ON pt.at = mv.at GROUP BY 1"""


def cp19(s, d):
    w = W.partitionBy("series").orderBy("day")
    return _series(s, d).withColumn("p", F.lag("x").over(w)).groupBy("series").agg(F.round(F.corr("x", "p"), R).alias("r1"))


def cp09(s, d):
    """Weekday effects: medians of what a centred median of five days leaves."""
    w = W.partitionBy("series").orderBy("day").rowsBetween(-2, 2)
    r = _series(s, d).withColumn("rest", F.col("x") - F.expr("percentile(x, 0.5)").over(w)).withColumn("weekday", (F.col("day") % 7))
    return r.groupBy("series", "weekday").agg(F.round(F.percentile("rest", F.lit(0.5)), R).alias("effect"))


CP09 = """
WITH x AS (SELECT event_type AS series, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day, count(*) AS x FROM events GROUP BY 1, 2),
     r AS (SELECT *, x - quantile_cont(x, 0.5) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rest FROM x)
SELECT series, CAST(day % 7 AS INT) AS weekday, round(quantile_cont(rest, 0.5), 6) AS effect FROM r GROUP BY 1, 2"""

# ---------------------------------------------------------------- graphs


def _touches(s, d, key="l_partkey"):
    """(key, who, t): first touches, as an order's earliest time is that of all its lines; and into how many parts rows are dealt."""
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    parts = parts_for(li.count())  # of the files' footers
    # Both sides are dealt out by order, and what there is twice of one is combined where it lies.
    x = li.select(F.col(key).alias("key"), F.col("l_orderkey").alias("who")).repartition(parts, "who").distinct()
    at = o.select(F.col("o_orderkey").alias("who"), F.col("o_orderdate").alias("t")).repartition(parts, "who").groupBy("who").agg(F.min("t").alias("t"))
    return x.join(at.hint("merge"), "who").select("key", "who", "t"), parts


def dg03(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("key")).agg(F.min("l_shipdate").alias("first"), F.max((F.col("l_returnflag") == "R").cast("int")).cast("boolean").alias("wrote"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))), lambda x: x.cast("string")), ",").alias("lines"))


def _edges(s, d, key="l_partkey", times=False):
    touches, parts = _touches(s, d, key)
    return graph.last_writer_edges(touches, "key", "who", "t", first=True, parts=parts, times=times)


EDGES = """
WITH RECURSIVE f AS (SELECT l_partkey AS key, l_orderkey AS who, min(o_orderdate) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
     a AS (SELECT key, t, max(who) AS last FROM f GROUP BY 1, 2), p AS (SELECT key, t, lag(last) OVER (PARTITION BY key ORDER BY t) AS parent FROM a),
     e AS (SELECT who, parent, key FROM f JOIN p USING (key, t) WHERE parent IS NOT NULL)"""


def dg05(s, d):
    e = _edges(s, d, times=True)
    e = e.select("who", "parent", *(micros(t).alias(t) for t in ("t", "before")))
    return graph.layers(e, "who", "parent", times=("t", "before")).select("node", "layer")


DG05 = EDGES + """,
     n AS (SELECT who AS node FROM e UNION SELECT parent FROM e),
     w AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT who FROM e) UNION SELECT e.who, w.layer + 1 FROM e JOIN w ON e.parent = w.node)
SELECT node, CAST(max(layer) AS BIGINT) AS layer FROM w GROUP BY 1"""


def dg07(s, d):
    return graph.degrees(_edges(s, d), "who", "parent").select("n_edges", "n_children", F.round("multi_share", R).alias("multi_share"), F.round("mean_parents", R).alias("mean_parents"))


def f35(s, d):
    """The chance that three drawn orders of a customer's w hold one of m: one less a product of as many shares as are drawn."""
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("w"), F.count_if(F.col("o_orderstatus") == "F").alias("m"))
    none = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(1.0), lambda p, i: p * F.greatest(F.lit(0), F.col("w") - F.col("m") - i) / (F.col("w") - i))
    return n.where("w >= 3").select("o_custkey", F.round(1 - none, R).alias("p"))


F35 = """
WITH n AS (SELECT o_custkey, count(*) AS w, count(*) FILTER (o_orderstatus = 'F') AS m FROM orders GROUP BY 1)
SELECT o_custkey, round(CASE WHEN w - m < 3 THEN 1 ELSE 1 - exp(lgamma(w - m + 1) - lgamma(w - m - 2) - lgamma(w + 1) + lgamma(w - 2)) END, 6) AS p FROM n WHERE w >= 3"""


def va04(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", "l_returnflag", F.round(stats.mid_rank(["l_returnflag"], "n"), R).alias("percentile"), stats.average_rank(["l_returnflag"], "n").cast("double").alias("rank"))


VA04 = """
WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, round((rank() OVER w - 1 + count(*) OVER (PARTITION BY l_returnflag, n) / 2) / count(*) OVER (PARTITION BY l_returnflag), 6) AS percentile, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, n) - 1) / 2 AS rank FROM n WINDOW w AS (PARTITION BY l_returnflag ORDER BY n)"""


def va06(s, d):
    """A hundred rows shared out to sources in proportion; what is over goes to the largest remainders."""
    n = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    q = n.withColumn("q", 97 * F.col("n") / F.sum("n").over(W.partitionBy())).withColumn("base", F.floor("q"))  # a row for each source
    k = F.row_number().over(W.orderBy(F.desc(F.round(F.col("q") - F.col("base"), 9)), "source"))
    left = 97 - F.sum("base").over(W.partitionBy())
    return q.withColumn("k", k).withColumn("left", left).select("source", (F.col("base") + (F.col("k") <= F.col("left")).cast("int")).cast("long").alias("n"))


VA06 = """
WITH q AS (SELECT source, 97 * count(*) / sum(count(*)) OVER () AS q FROM documents GROUP BY 1),
     k AS (SELECT *, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, source) AS k, 97 - sum(floor(q)) OVER () AS l FROM q)
SELECT source, CAST(floor(q) + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM k"""

# ---------------------------------------------------------------- sources and streams

SPEC = jsonl.TableSpec("events", {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}, ("props",), {"k": "try_cast(get_json_object(get_json_object(raw, '$.props'), '$.k') AS INT)"}, "event_id")


def src01(s, d):
    """Events written as gzip JSON lines and read again with the declared schema."""
    path = f"{shared_dir(s)}/lines-{uuid.uuid4().hex}"
    e = table(s, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    e.select(F.to_json(F.struct("event_id", "ts", "user_id", "event_type", "value", "props"))).write.option("compression", "gzip").text(path)
    main, text = jsonl.typed(jsonl.read_lines(s, path), SPEC)
    return main.join(text.select(F.col("event_id").cast("long").alias("event_id"), "props"), "event_id").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "k")


def src06(s, d):
    lines = table(s, d, "events").select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).when(F.col("event_id") % 51 == 0, F.lit('{"event_id": 1, "ts": "never", "more": 2}')).otherwise(F.to_json(F.struct("event_id", "user_id"))).alias("raw"))
    return jsonl.counters(lines, SPEC)


SRC06 = "SELECT count(*) AS n_lines, count(*) FILTER (event_id % 50 = 0) AS n_bad, count(*) FILTER (event_id % 50 <> 0 AND event_id % 51 = 0) AS n_unknown, count(*) FILTER (event_id % 50 <> 0 AND event_id % 51 = 0) AS bad_ts FROM events"


def _stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def st01(s, d):
    name = f"blocks_{uuid.uuid4().hex}"
    got = live.run_to_files(live.stream_blocks(_stream(s, d), "ts", 900, ["user_id"]), name, "complete")
    return got.select("user_id", "date", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_rows")


def st04(s, d):
    return live.run_to_files(live.stream_daily(_stream(s, d), "ts", ["event_type"]), f"daily_{uuid.uuid4().hex}", "complete")


def st02(s, d):
    """Online run lengths over a stream of daily counts."""
    path = f"{shared_dir(s)}/daily-{uuid.uuid4().hex}"
    _series(s, d).withColumn("x", F.col("x") / 50 - 1).coalesce(1).write.parquet(path)
    stream = s.readStream.schema("series string, day int, x double").parquet(path)
    return live.run_to_files(live.stream_runs(stream, "series", "day", "x", 0.05), f"runs_{uuid.uuid4().hex}", "append")


def st05(s, d):
    e = _stream(s, d).withColumnRenamed("event_id", "id")
    got = live.stream_candidates(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "ts", 0, 21600)
    return live.run_to_files(got, f"pairs_{uuid.uuid4().hex}", "append")


def _st01_sql():
    from eventloom.plans.timeline import BLOCKS_SQL

    return f'SELECT user_id, date, start, "end", n_rows FROM ({BLOCKS_SQL})'


QUERIES = {
    "EX-01_parent_pairs": (lambda s, d: _pairs(s, d).withColumn("dt", F.round("dt", 5)), f"SELECT user_id, target, source, i, j, round(dt, 5) AS dt FROM ({PAIRS})"),
    "EX-02_exposure": (ex02, EX02),
    "EX-03_loglik": (ex03, EX03),
    "EX-05_posterior": (lambda s, d: _posterior(s, d).withColumn("prob", F.round("prob", R)), f"SELECT target, source, i, j, round(prob, 6) AS prob FROM ({POSTERIOR})"),
    "EX-06_shares": (lambda s, d: excite.shares(_posterior(s, d)).withColumn("mass", F.round("mass", 4)), f"SELECT i, CASE WHEN source IS NULL THEN 'base' WHEN i = j THEN 'self' ELSE 'other' END AS parent, round(sum(prob), 4) AS mass FROM ({POSTERIOR}) GROUP BY 1, 2"),
    "EX-07_fit": (ex07, None),
    "EX-12_simulate": (ex12, None),
    "EX-13_time_rescaling": (ex13, None),
    "EX-20_likeliest_parent": (ex20, EX20),
    "SV-01_relations": (sv01, SV01),
    "SV-08_presence_spells": (sv08, SV08),
    "SV-09_hazard_km": (sv09, SV09),
    "SV-10_likelihoods": (sv10, SV10),
    "TR-07_candidates": (_cand, CAND + "\nSELECT * FROM c"),
    "TR-11_posterior": (lambda s, d: _post(s, d).withColumn("post", F.round("post", R)), POST + "\nSELECT unit, child, parent, dt, round(post, 6) AS post FROM p"),
    "TR-12_likeliest": (lambda s, d: transmit.likeliest(_post(s, d)).withColumn("post", F.round("post", R)), MAP + "\nSELECT child, parent, round(post, 6) AS post FROM m"),
    "TR-14_forest": (tr14, TR14),
    "TR-17_permutation": (tr17, TR17),
    "TR-18_bootstrap": (tr18, TR18),
    "TR-20_adjacent_correlation": (tr20, TR20),
    "TR-22_attractor": (tr22, TR22),
    "TR-24_seen_groups": (tr24, TR24),
    "CP-01_noise_scale": (cp01, CP01),
    "CP-02_changes": (lambda s, d: shift.detect(_series(s, d), "series", "day", "x", 0.5, 3), None),
    "CP-09_weekday_effects": (cp09, CP09),
    "CP-10_aligned": (lambda s, d: shift.aligned(_points(s, d), _entries(s), 1), POINTS + "\nSELECT count(*) AS s FROM pt WHERE EXISTS (SELECT 1 FROM en WHERE pt.at BETWEEN lo - 1 AND hi + 1)"),
    "CP-11_shift_null": (lambda s, d: shift.shift_null(_points(s, d), _entries(s), 30, 1), CP11),
    "CP-19_autocorrelation": (cp19, "WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2), p AS (SELECT *, lag(x) OVER (PARTITION BY series ORDER BY day) AS p FROM x) SELECT series, round(corr(x, p), 6) AS r1 FROM p GROUP BY 1"),
    "DG-03_session_keys": (dg03, "SELECT l_orderkey, l_suppkey AS key, min(l_shipdate) AS first, bool_or(l_returnflag = 'R') AS wrote, coalesce(array_to_string(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')), ','), '') AS lines FROM lineitem GROUP BY 1, 2"),
    "DG-04_last_writer": (_edges, EDGES + "\nSELECT who, parent, key FROM e"),
    "DG-05_layers": (dg05, DG05),
    "DG-07_structure": (dg07, EDGES + ",\n     n AS (SELECT who, count(DISTINCT parent) AS n FROM e GROUP BY 1)\nSELECT CAST(sum(n) AS BIGINT) AS n_edges, count(*) AS n_children, round(avg(CAST(n > 1 AS INT)), 6) AS multi_share, round(avg(n), 6) AS mean_parents FROM n"),
    "F-35_hit_probability": (f35, F35),
    "SIM-02_teams": (lambda s, d: swarm.runs(s, 64, [1, 2, 4, 8]), None),
    "VA-04_percentiles": (va04, VA04),
    "VA-06_allocation": (va06, VA06),
    "SRC-01_json_lines": (src01, "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "SRC-06_counters": (src06, SRC06),
    "ST-01_stream_blocks": (st01, _st01_sql()),
    "ST-02_stream_runs": (st02, None),
    "ST-05_stream_candidates": (st05, "SELECT l.user_id, l.event_id AS lid, r.event_id AS rid, (epoch_us(r.ts) - epoch_us(l.ts)) / 1e6 AS dt FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'click' AND r.ts BETWEEN l.ts AND l.ts + INTERVAL 6 HOUR"),
    "ST-04_stream_daily": (st04, "SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2"),
}
