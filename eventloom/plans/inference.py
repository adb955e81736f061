"""Nulls, draws, fits and designs; lookups with fallbacks; checks of conclusions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import excite, fits, graph, resample, shift, swarm, transmit
from eventloom.plans import analysis as an
from eventloom.plans import studies as st
from eventloom.session import table
from eventloom.shared import materialize

R = 6


def _ev(s, d, kind=None):
    e = table(s, d, "events")
    return e if kind is None else e.where(F.col("event_type") == kind)


def K(c, path):  # noqa: N802
    return F.get_json_object(c, path)


def tr02(s, d):
    """Values of a row that are not its own date's numbers."""
    e = _ev(s, d).select("event_id", K("props", "$.k").cast("int").alias("k"), F.array(F.dayofmonth("ts"), F.month("ts"), F.dayofyear("ts")).alias("own"))
    return e.where(~F.array_contains("own", F.col("k"))).select("event_id", "k")


def tr04(s, d):
    """Days on which a user is present, under two rules."""
    n = _ev(s, d).groupBy("user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.count("*").alias("n"))
    rules = s.createDataFrame([("any", 1), ("two", 2)], "rule string, least int")  # two rules
    return n.join(F.broadcast(rules), F.col("n") >= F.col("least")).groupBy("rule", "user_id").agg(F.count("*").alias("days"), F.min("day").alias("first"))


def tr06(s, d):
    """Purchases whose user viewed the same thing before."""
    v = _ev(s, d, "view").select("user_id", K("props", "$.k").alias("k"), F.col("ts").alias("at"))
    first = v.groupBy("user_id", "k").agg(F.min("at").alias("first"))
    return _ev(s, d, "purchase").select("event_id", "user_id", "ts", K("props", "$.k").alias("k")).join(first, ["user_id", "k"]).where("first < ts").select("event_id", "first")


def tr09(s, d):
    """Density of the log of intervals, where a child has one candidate."""
    c = an._cand(s, d).withColumn("n", F.count("*").over(W.partitionBy("child"))).where("n = 1").groupBy("dt").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.linspace(0, 1.5, 31)
        return pd.DataFrame({"at": grid, "density": fits.kde(np.log10(pdf["dt"].to_numpy(float)), grid, pdf["n"].to_numpy(float))})

    # A row for each day in reach, in one group.
    return c.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(run, "at double, density double")


def tr10(s, d):
    """A weight for each candidate: of its unit's brand and distance, else of the distance, else of all."""
    c = an._cand(s, d).join(table(s, d, "part").select(F.col("p_partkey").alias("unit"), "p_brand"), "unit")
    n = materialize(c.groupBy("p_brand", "dt").agg(F.count("*").alias("n")), "counts")  # read four times
    fine = n.where("n >= 30").select("p_brand", "dt", F.col("n").alias("a"))
    mid = n.groupBy("dt").agg(F.sum("n").alias("b")).where("b >= 650")
    top = n.agg(F.sum("n").alias("c"))
    # Brands by days, days, and one row.
    return n.select("p_brand", "dt").join(F.broadcast(fine), ["p_brand", "dt"], "left").join(F.broadcast(mid), "dt", "left").crossJoin(F.broadcast(top)).select("p_brand", "dt", F.coalesce("a", "b", "c").alias("w"))


TR10 = an.CAND + """,
     n AS (SELECT p_brand, dt, count(*) AS n FROM c JOIN part ON p_partkey = unit GROUP BY 1, 2)
SELECT p_brand, dt, CAST(CASE WHEN n >= 30 THEN n WHEN sum(n) OVER (PARTITION BY dt) >= 650 THEN sum(n) OVER (PARTITION BY dt) ELSE sum(n) OVER () END AS BIGINT) AS w FROM n"""


def tr16(s, d):
    """Nodes whose every step from the root had one candidate only."""
    b = an._best(s, d).select("child", "parent", "n").distinct()
    # Paths are cut at nodes with several candidates; a node is determined if its path ends elsewhere.
    top = graph.forest(b.select("child", F.when(F.col("n") == 1, F.col("parent")).alias("parent")), "child", "parent")
    cut = b.where("n > 1").select(F.col("child").alias("root"))
    return top.join(cut, "root", "left_anti").select("node")


TR16 = an.MAP.replace("WITH o AS", "WITH RECURSIVE o AS") + """,
     k AS (SELECT child, count(*) AS n FROM c GROUP BY 1), b AS (SELECT m.child, m.parent, k.n FROM m JOIN k USING (child)),
     f AS (SELECT child FROM b WHERE n = 1 AND parent NOT IN (SELECT child FROM b) UNION ALL SELECT b.child FROM b JOIN f ON b.parent = f.child WHERE b.n = 1)
SELECT child AS node FROM f"""


def tr25(s, d):
    """The mean interval of drawn forests."""
    return st.drawn(s, d).groupBy("draw").agg(F.count("*").alias("n"), F.round(F.avg("dt"), R).alias("mean"))


def tr28(s, d):
    """Median, ends and share below a level, over draws (here, lines)."""
    li = table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("x"))
    return li.groupBy("l_returnflag").agg(*(F.round(F.percentile("x", F.lit(q)), R).alias(n) for n, q in (("median", 0.5), ("lo", 0.025), ("hi", 0.975))), F.round(F.avg((F.col("x") < 0.05).cast("double")), R).alias("below"))


def cp13(s, d):
    """The alignment statistic with entries moved by whole weeks."""
    return shift.shift_null(an._points(s, d), an._entries(s), 28, 1).where("offset % 7 = 0")


def cp14(s, d):
    """The test by exact shifts: statistic and share of shifts that do as well."""
    own = shift.aligned(an._points(s, d), an._entries(s), 1).select(F.col("s").alias("own"))
    null = shift.shift_null(an._points(s, d), an._entries(s), 30, 1)
    return null.crossJoin(own).groupBy("own").agg(F.count("*").alias("shifts"), F.round(F.avg((F.col("s") >= F.col("own")).cast("double")), R).alias("p"))  # a row


CP14 = an.CP11.rsplit("\nSELECT", 1)[0] + """,
     nu AS (SELECT o, count(pt.at) AS s FROM mv LEFT JOIN pt ON pt.at = mv.at GROUP BY 1), ow AS (SELECT count(*) AS own FROM pt WHERE EXISTS (SELECT 1 FROM en WHERE pt.at BETWEEN lo - 1 AND hi + 1))
SELECT own, count(*) AS shifts, round(avg(CAST(s >= own AS INT)), 6) AS p FROM nu, ow GROUP BY 1"""


def cp05(s, d):
    """Online run lengths of each series, day by day."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        x = pdf["x"].to_numpy(float)
        z = (x - np.median(x)) / (x.std() or 1.0)
        return pd.DataFrame({"series": pdf["series"], "day": pdf["day"], "run": shift.bocpd(z, 0.05)})

    return an._series(s, d).groupBy("series").applyInPandas(run, "series string, day int, run int")


def cp04(s, d):
    """Where the strongest change falls when residuals are drawn in blocks of three."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("day")["x"].to_numpy(float)
        cuts = shift.pelt((x - np.median(x)) / (x.std() or 1.0), 1.0, 5) or [len(x) // 2]
        edges = [0, *cuts, len(x)]
        fit = np.concatenate([np.full(b - a, x[a:b].mean()) for a, b in zip(edges, edges[1:])])
        rest, rng, rows = x - fit, np.random.default_rng(len(x)), []
        for rep in range(50):
            at = rng.integers(0, max(1, len(x) - 2), (len(x) + 2) // 3)
            y = fit + rest[(at[:, None] + np.arange(3)).ravel()[: len(x)].clip(0, len(x) - 1)]
            got = shift.pelt((y - np.median(y)) / (y.std() or 1.0), 1.0, 5)
            rows.append((pdf["series"].iloc[0], rep, got[0] if got else -1))
        return pd.DataFrame(rows, columns=["series", "rep", "at"])

    return an._series(s, d).groupBy("series").applyInPandas(run, "series string, rep int, at int")


def cp20(s, d):
    """Points labelled by what is near: an entry, a weekend, neither."""
    p = an._points(s, d).groupBy("at").agg(F.count("*").alias("n"))
    near = an._entries(s).select(F.explode(F.sequence(F.col("lo"), F.col("hi"))).alias("at")).distinct().withColumn("e", F.lit(1))
    return p.join(F.broadcast(near), "at", "left").select("at", "n", F.when(F.col("e") == 1, "entry").when(F.col("at") % 7 >= 5, "weekend").otherwise("none").alias("cause"), F.format_string("/day/%02d", "at").alias("link"))  # calendar days


def dg02(s, d):
    """Of each part, its usual supplier: two lines or more, and a tenth of them."""
    n = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    b = n.groupBy("l_partkey").agg(F.max(F.struct("n", (-F.col("l_suppkey")).alias("k"))).alias("m"), F.sum("n").alias("all"))
    return b.where("m.n >= 2 AND 10 * m.n >= all").select("l_partkey", (-F.col("m.k")).alias("supplier"), F.col("m.n").alias("votes"))


def dg10(s, d):
    """Structure of the dependency graph without each quarter's orders."""
    e = an._edges(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("who"), F.quarter("o_orderdate").alias("q")), "who")
    left = e.crossJoin(F.broadcast(s.range(1, 5).withColumnRenamed("id", "without"))).where("q <> without")  # four quarters
    n = left.select("without", "who", "parent").distinct().groupBy("without", "who").agg(F.count("*").alias("n"))
    return n.groupBy("without").agg(F.count("*").alias("nodes"), F.round(F.avg("n"), R).alias("mean_parents"))


def sim01(s, d):
    """Layers and parents of generated task graphs."""

    def run(batches):
        for pdf in batches:
            rows = []
            for seed in pdf["id"]:
                parents, layer, time = swarm.grow(np.random.default_rng(int(seed)), 80, 6, 0.3)
                rows += [(int(seed), int(k), int((layer == k).sum()), float(np.mean([len(parents[i]) for i in np.flatnonzero(layer == k)]))) for k in range(6)]
            yield pd.DataFrame(rows, columns=["seed", "layer", "n", "parents"])

    return s.range(32).mapInPandas(run, "seed long, layer int, n int, parents double")


def sim06(s, d):
    """Mean speedups with bootstrap ends."""
    r = swarm.runs(s, 64, [2, 4, 8]).select("n_agents", F.col("rep").alias("graph"), "speedup", F.lit(1.0).alias("one"))
    return resample.bootstrap_ratio(r, ["n_agents"], "graph", "speedup", "one", 100)


def va01(s, d):
    """Findings once each: the latest of a user and date."""
    e = _ev(s, d, "error").withColumn("date", F.to_date("ts"))
    return e.withColumn("k", F.row_number().over(W.partitionBy("user_id", "date").orderBy(F.desc("ts"), F.desc("event_id")))).where("k = 1").select("user_id", "date", "event_id")


def va02(s, d):
    """Of each target, the mass of parents of its own kind, of others, and of none."""
    p = an._posterior(s, d)
    return p.groupBy("target").agg(F.round(F.sum(F.when(F.col("source").isNull(), F.col("prob")).otherwise(0.0)), R).alias("base"), F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("prob")).otherwise(0.0)), R).alias("own"))


VA02 = f"SELECT target, round(sum(CASE WHEN source IS NULL THEN prob ELSE 0 END), 6) AS base, round(sum(CASE WHEN i = j THEN prob ELSE 0 END), 6) AS own FROM ({an.POSTERIOR}) GROUP BY 1"


def va08(s, d):
    """Accuracy of a length rule, weighted by how many a sampled row stands for."""
    v = st.va07(s, d).join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    ok = ((F.col("n_chars") > 300).cast("int") == F.col("quality")).cast("double")
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum(ok / F.col("p")) / F.sum(1 / F.col("p")), 4).alias("accuracy"))


VA08 = "SELECT lang, count(*) AS n, round(sum(CAST(CAST(n_chars > 300 AS INT) = quality AS INT) / p) / sum(1 / p), 4) AS accuracy FROM (" + st.QUERIES["VA-07_review_design"][1] + ") JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY 1"


def ex10(s, d):
    """Branching of each day's fit: spectral radius, and whether it is below one."""
    return an.ex07(s, d).select("by", "n", "rho", (F.col("rho") < 1).alias("stable"))


def ex15(s, d):
    """How well fits recover what was simulated, by replicate."""

    def run(batches):
        mu, n = np.array([0.4, 0.2]), np.array([[0.4, 0.1], [0.2, 0.3]])
        for pdf in batches:
            rows = []
            for rep in pdf["id"]:
                t, kind, _ = excite.simulate(np.random.default_rng([8, int(rep)]), mu, n, 1.0, 600.0)
                m, a, _ = excite.fit_em(t, kind, 2, 600.0, np.array([1.0]), 8.0, most=100)
                rows.append((int(rep), len(t), float(np.abs(a[:, :, 0] - n).mean()), float(np.abs(m - mu).mean())))
            yield pd.DataFrame(rows, columns=["rep", "n", "branching_error", "base_error"])

    return s.range(16).mapInPandas(run, "rep long, n long, branching_error double, base_error double")


def ex18(s, d):
    """Whether a user acts again within six hours, by decayed counts of its own and others' kinds; a fit for each kind."""
    p = an._pairs(s, d).withColumn("x", F.exp(-F.col("dt") / 3600))
    x = p.groupBy("target", "i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(0.0)).alias("own"), F.sum(F.when(F.col("i") != F.col("j"), F.col("x")).otherwise(0.0)).alias("other"))
    acts = an._pairs(s, d).select(F.col("source").alias("target")).distinct().withColumn("y", F.lit(1.0))
    rows = materialize(x.join(acts, "target", "left").fillna(0.0, ["y"]).select("i", "own", "other", "y"), "opportunities")
    found = fits.logistic_by(rows, "i", ["own", "other"], "y")
    weights = s.createDataFrame([(k, *map(float, w)) for k, w in sorted(found.items())], "i string, own double, other double, base double")
    # A row for each kind of act.
    return rows.groupBy("i").agg(F.count("*").alias("n")).join(F.broadcast(weights), "i").select("i", "n", *(F.round(c, 4).alias(c) for c in ("own", "other", "base")))


def ex19(s, d):
    """Turns that answer a question: the turn before ends with a question mark."""
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("to"), F.rtrim(F.lag("text").over(w)).endswith("?").alias("asked")).where("to IS NOT NULL")


def ex24(s, d):
    """Of each five days, users present, and the share of all they are."""
    g = _ev(s, d).select(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5).cast("int").alias("win"), "user_id").distinct().groupBy("win").agg(F.count("*").alias("present"))
    n = _ev(s, d).agg(F.countDistinct("user_id").alias("n"))
    return g.crossJoin(n).select("win", "present", F.round(F.col("present") / F.col("n"), R).alias("share"))  # a row


def sv12(s, d):
    """Beta-geometric lifetimes of each group of spells."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a, b, ll = fits.beta_geometric(x["g"].to_numpy(float), x["at_risk"].to_numpy(float), x["lost"].to_numpy(float))
        lost, kept = x["lost"].sum(), (x["at_risk"] - x["lost"]).sum()
        h = lost / x["at_risk"].sum()
        flat = (lost * np.log(h) if lost else 0.0) + (kept * np.log1p(-h) if kept else 0.0)
        return pd.DataFrame({"grp": [int(x["grp"].iloc[0])], "a": [a], "b": [b], "loglik": [ll], "p": [float(fits.chi2_tail(2 * (ll - flat), 1))]})

    # A group has a row for each day.
    return an._risk(s, d).groupBy("grp").applyInPandas(run, "grp long, a double, b double, loglik double, p double")


def sv15(s, d):
    """Of what ends, the share that comes back, by weekday of the end."""
    w = W.partitionBy("user_id").orderBy("spell")
    x = an.sv08(s, d).withColumn("next", F.lead("start").over(w)).where("end < 29")
    return x.groupBy((F.col("end") % 7).alias("weekday")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("next").isNotNull().cast("double")), R).alias("restored"))


def sv17(s, d):
    """Users' counts in the two halves of the month, paired."""
    x = _ev(s, d).groupBy("user_id").agg(F.count_if(F.dayofmonth("ts") <= 15).alias("a"), F.count_if(F.dayofmonth("ts") > 15).alias("b"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), R).alias("diff"), F.round(F.avg(F.col("b") - F.col("a")) / (F.stddev_samp(F.col("b") - F.col("a")) / F.sqrt(F.count("*"))), R).alias("t"))


QUERIES = {
    "TR-02_own_day": (tr02, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) NOT IN (day(ts), month(ts), dayofyear(ts))"),
    "TR-04_presence_rules": (tr04, f"WITH n AS (SELECT user_id, day, count(*) AS n FROM ({st.DAYS}) GROUP BY 1, 2) SELECT rule, user_id, count(*) AS days, min(day) AS first FROM n, (VALUES ('any', 1), ('two', 2)) v(rule, least) WHERE n >= least GROUP BY 1, 2"),
    "TR-06_environment": (tr06, "SELECT p.event_id, min(v.ts) AS first FROM events p JOIN events v ON p.user_id = v.user_id AND json_extract_string(p.props, '$.k') = json_extract_string(v.props, '$.k') AND v.ts < p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY 1"),
    "TR-09_interval_density": (tr09, None),
    "TR-10_fallbacks": (tr10, TR10),
    "TR-16_determined": (tr16, TR16),
    "TR-25_draws": (tr25, st.TR13.rsplit("\nSELECT", 1)[0] + "\nSELECT draw, count(*) AS n, round(avg(dt), 6) AS mean FROM w JOIN c USING (child, parent) GROUP BY 1"),
    "TR-28_draw_summary": (tr28, "WITH x AS (SELECT l_returnflag, avg(l_discount) AS x FROM lineitem GROUP BY l_returnflag, l_suppkey) SELECT l_returnflag, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(avg(CAST(x < 0.05 AS INT)), 6) AS below FROM x GROUP BY 1"),
    "CP-04_bootstrap_places": (cp04, None),
    "CP-05_online": (cp05, None),
    "CP-13_week_shifts": (cp13, an.CP11.replace("range(3, 28)", "range(3, 26)").replace("% 30 + 30) % 30", "% 28 + 28) % 28").removesuffix("GROUP BY 1") + "WHERE o % 7 = 0 GROUP BY 1"),
    "CP-14_shift_test": (cp14, CP14),
    "CP-20_causes": (cp20, an.POINTS + "\nSELECT pt.at, count(*) AS n, CASE WHEN EXISTS (SELECT 1 FROM en WHERE pt.at BETWEEN lo AND hi) THEN 'entry' WHEN pt.at % 7 >= 5 THEN 'weekend' ELSE 'none' END AS cause, format('/day/{:02d}', pt.at) AS link FROM pt GROUP BY pt.at"),
    "DG-02_usual_supplier": (dg02, "WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS k FROM n) SELECT l_partkey, l_suppkey AS supplier, n AS votes FROM r WHERE k = 1 AND n >= 2 AND 10 * n >= a"),
    "DG-10_robustness": (dg10, an.EDGES + ",\n     q AS (SELECT DISTINCT w.x AS \"without\", who, parent FROM e JOIN orders ON o_orderkey = who, (VALUES (1::BIGINT), (2), (3), (4)) w(x) WHERE quarter(o_orderdate) <> w.x), n AS (SELECT \"without\", who, count(*) AS n FROM q GROUP BY 1, 2)\nSELECT \"without\", count(*) AS nodes, round(avg(n), 6) AS mean_parents FROM n GROUP BY 1"),
    "SIM-01_graphs": (sim01, None),
    "SIM-06_mean_speedups": (sim06, None),
    "VA-01_findings": (va01, "SELECT user_id, CAST(ts AS DATE) AS date, event_id FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"),
    "VA-02_target_mass": (va02, VA02),
    "VA-08_design_weighted": (va08, VA08),
    "EX-10_branching": (ex10, None),
    "EX-15_recovery": (ex15, None),
    "EX-18_opportunity": (ex18, None),
    "EX-19_replies": (ex19, "SELECT conv_id, turn, lag(turn) OVER w AS \"to\", ends_with(rtrim(lag(text) OVER w), '?') AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY \"to\" IS NOT NULL"),
    "EX-24_rolling_presence": (ex24, f"SELECT CAST(day // 5 AS INT) AS win, count(DISTINCT user_id) AS present, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM ({st.DAYS}) GROUP BY 1"),
    "SV-12_beta_geometric": (sv12, None),
    "SV-15_restored": (sv15, f"WITH x AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY spell) AS n FROM ({an.SV08})) SELECT CAST(\"end\" % 7 AS INT) AS weekday, count(*) AS n, round(avg(CAST(n IS NOT NULL AS INT)), 6) AS restored FROM x WHERE \"end\" < 29 GROUP BY 1"),
    "SV-17_paired": (sv17, "WITH x AS (SELECT count(*) FILTER (day(ts) > 15) - count(*) FILTER (day(ts) <= 15) AS d FROM events GROUP BY user_id) SELECT count(*) AS n, round(avg(d), 6) AS diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM x"),
}
