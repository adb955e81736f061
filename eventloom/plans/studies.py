"""Second-level queries of the analyses: tables by stratum, generation and window, comparisons and designs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators import excite, resample, survive, transmit
from eventloom.plans import analysis as an
from eventloom.session import table
from eventloom.shared import materialize

R = 6


def _ev(s, d, kind=None):
    e = table(s, d, "events")
    return e if kind is None else e.where(F.col("event_type") == kind)


def _day(c="ts"):
    return F.datediff(c, F.lit("2024-01-01"))


# ---------------------------------------------------------------- joins and windows


def jn17(s, d):
    """Candidate parents by channel: other actors within 20 days, the actor's own within 60."""
    o = an._occ(s, d)
    other = transmit.candidates(o, "unit", "occ", "day", "actor", 20).withColumn("channel", F.lit("other"))
    c = o.select("unit", F.col("occ").alias("child"), F.col("day").alias("cd"), "actor")
    p = o.select("unit", F.col("occ").alias("parent"), F.col("day").alias("pd"), "actor")
    own = c.join(p, ["unit", "actor"]).where("pd < cd AND pd >= cd - 60").select("unit", "child", "parent", (F.col("cd") - F.col("pd")).alias("dt"), F.lit("own").alias("channel"))
    return other.unionByName(own).groupBy("channel", "dt").agg(F.count("*").alias("n"))


JN17 = an.CAND.split(",\n     c AS")[0] + """
SELECT CASE WHEN a.actor = b.actor THEN 'own' ELSE 'other' END AS channel, a.day - b.day AS dt, count(*) AS n
FROM o a JOIN o b ON a.unit = b.unit AND b.day < a.day AND b.day >= a.day - CASE WHEN a.actor = b.actor THEN 60 ELSE 20 END GROUP BY 1, 2"""


def jn21(s, d):
    """Last writers by container: orders on one supplier."""
    return an._edges(s, d, "l_suppkey")


JN21 = an.EDGES.replace("l_partkey AS key", "l_suppkey AS key") + "\nSELECT who, parent, key FROM e"


def w09(s, d):
    """The latest other kind before each row of a user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    x = _ev(s, d).withColumn("p", F.lag("event_type").over(w)).withColumn("turn", F.when(F.col("p") != F.col("event_type"), F.col("p")))
    return x.select("event_id", F.last("turn", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("other"))


W09 = """
WITH x AS (SELECT event_id, user_id, ts, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, last_value(CASE WHEN p <> event_type THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS other FROM x"""


def w13(s, d):
    """Exponentially decayed counts of a user's earlier rows within reach."""
    p = an._pairs(s, d).groupBy("target").agg(F.sum(F.exp(-F.col("dt") / 3600)).alias("x"))
    return _ev(s, d).select(F.col("event_id").alias("target")).join(p, "target", "left").select("target", F.round(F.coalesce("x", F.lit(0.0)), R).alias("decayed"))


def w16(s, d):
    """Expected events of each kind up to each of its rows on a date, at the date's mean rate: running sums."""
    g = W.partitionBy("event_type", "date").orderBy("ts", "event_id")
    x = _ev(s, d).withColumn("date", F.to_date("ts")).withColumn("n", F.count("*").over(W.partitionBy("event_type", "date")))
    dt = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.coalesce(F.lag("ts").over(g), F.col("date").cast("timestamp_ntz")).cast("timestamp"))) / 1e6
    return x.withColumn("step", dt * F.col("n") / 86400).select("event_id", F.round(F.sum("step").over(g.rowsBetween(W.unboundedPreceding, 0)), R).alias("expected"))


W16 = """
WITH x AS (SELECT *, CAST(ts AS DATE) AS date, count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS n FROM events),
     y AS (SELECT *, (epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER w, epoch_us(date))) / 1e6 * n / 86400 AS step FROM x WINDOW w AS (PARTITION BY event_type, date ORDER BY ts, event_id))
SELECT event_id, round(sum(step) OVER (PARTITION BY event_type, date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS expected FROM y"""


def prj15(s, d):
    """Of each user's rows, those of the first ten days that have room for a week more."""
    g = _ev(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list(_day())).alias("days"), F.max(_day()).alias("last"))
    return g.select("user_id", F.size(F.filter("days", lambda x: x < 10)).cast("long").alias("early"), F.expr("CAST(size(filter(days, x -> x + 7 <= last)) AS BIGINT)").alias("forward"))


def prj16(s, d):
    c = table(s, d, "customer")
    private = {"c_name", "c_acctbal"}
    return c.drop(*(x for x in c.columns if x in private))


# ---------------------------------------------------------------- aggregations


def ag10(s, d):
    """Windows of rows by day, merged with the smaller neighbour until none has under 400 rows."""
    n = _ev(s, d).groupBy("event_type", _day().alias("day")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u = [[int(x), int(x), int(n)] for x, n in pdf.sort_values("day")[["day", "n"]].to_numpy().tolist()]
        while len(u) > 1:
            k = min(range(len(u)), key=lambda i: (u[i][2], i))
            if u[k][2] >= 400:
                break
            side = min((i for i in (k - 1, k + 1) if 0 <= i < len(u)), key=lambda i: (u[i][2], i))
            a, b = sorted((k, side))
            u[a : b + 1] = [[u[a][0], u[b][1], u[a][2] + u[b][2]]]
        return pd.DataFrame([(pdf["event_type"].iloc[0], *x) for x in u], columns=["event_type", "lo", "hi", "n"])

    return n.groupBy("event_type").applyInPandas(run, "event_type string, lo long, hi long, n long")


def _spell_units(s, d):
    return an.sv08(s, d).select("user_id", "spell", "start", "end", (F.col("end") - F.col("start") + 1).alias("last"), (F.col("end") < 29).alias("lost"))


def ag16(s, d):
    u = _spell_units(s, d).withColumn("grp", F.floor(F.col("start") / 10).cast("int"))
    return survive.hazards(survive.risk_counts(u, ["grp"], "last", "lost"), ["grp"]).where("at_risk >= 5").select("grp", "g", F.round("hazard", R).alias("hazard"))


def _risk_sql(grp: str, where: str = "true") -> str:
    return f"""
WITH u AS (SELECT {grp} AS grp, "end" - start + 1 AS last, "end" < 29 AS lost FROM ({an.SV08}) WHERE {where}),
     g AS (SELECT DISTINCT grp, last AS g FROM u UNION SELECT DISTINCT grp, last + 1 FROM u UNION SELECT DISTINCT grp, 1 FROM u),
     r AS (SELECT g.grp, CAST(g.g AS BIGINT) AS g, count(*) FILTER (u.last >= g.g) AS at_risk, count(*) FILTER (u.last = g.g AND u.lost) AS lost FROM g JOIN u USING (grp) GROUP BY 1, 2 HAVING count(*) FILTER (u.last >= g.g) > 0)"""


def ag17(s, d):
    """Risk sets of spells that begin in the five days before, and after, the middle of the month."""
    u = _spell_units(s, d).where("start BETWEEN 10 AND 19").withColumn("grp", F.when(F.col("start") < 15, "before").otherwise("after"))
    return survive.risk_counts(u, ["grp"], "last", "lost")


def ag18(s, d):
    u = _spell_units(s, d).where("spell = 2").withColumn("grp", F.lit("second"))
    return survive.risk_counts(u, ["grp"], "last", "lost")


def _tree(s, d):
    """(node, root, generation, parent, dt) of the likeliest forest."""
    best = an._best(s, d)
    return an._forest(s, d, best).join(best.select(F.col("child").alias("node"), "parent", "dt"), "node", "left")


TREE = an.TR14.rsplit("\nSELECT", 1)[0] + ",\n     tr AS (SELECT f.node, f.root, f.generation, m.parent, c.dt FROM f LEFT JOIN m ON m.child = f.node LEFT JOIN c ON c.child = m.child AND c.parent = m.parent)"


def ag20(s, d):
    # A row for each generation and day in reach, from which medians come.
    n = materialize(_tree(s, d).where("dt IS NOT NULL").groupBy("generation", "dt").agg(F.count("*").alias("n")), "intervals")
    return n.groupBy("generation").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("dt")) / F.sum("n"), R).alias("mean"), F.percentile("dt", F.lit(0.5), F.col("n")).alias("median"))


def ag21(s, d):
    t = materialize(_tree(s, d).select("node", "generation", "parent"), "tree")
    kids = t.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    g = t.join(kids, "node", "left").fillna(0, ["kids"])
    return g.groupBy("generation").agg(F.count("*").alias("n"), F.round(F.avg("kids"), R).alias("offspring"), F.round(F.avg((F.col("kids") == 0).cast("double")), R).alias("childless"))


def ag22(s, d):
    """How often an actor restates a unit, five times or more together."""
    n = an._occ(s, d).groupBy("unit", "actor").agg(F.count("*").alias("n"))
    return n.groupBy(F.least("n", F.lit(5)).alias("times")).agg(F.count("*").alias("owners"))


def ag24(s, d):
    """Pairs of nodes with a parent in common, by parent: counted, not made."""
    n = an._edges(s, d).select("who", "parent").distinct().groupBy("parent").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("parents"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.max("n").alias("widest"))


def ag27(s, d):
    o = table(s, d, "orders").join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("f")).distinct(), "o_orderkey", "left")
    g = o.groupBy("o_orderkey", "o_orderpriority").agg(F.max((F.col("f") == "R").cast("int")).alias("r"))
    return g.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1).alias("covered"), F.round(F.avg(F.coalesce("r", F.lit(0)).cast("double")), R).alias("share"))


# ---------------------------------------------------------------- excitation


def ex04(s, d):
    p = an._posterior(s, d).where("source IS NOT NULL")
    return p.groupBy("i", "j").agg(F.count("*").alias("n"), F.round(F.sum("prob"), 4).alias("mass"))


def ex11(s, d):
    """Fits of one kind pair over days drawn anew."""
    e = an._events(s, d).where("i IN ('click', 'view')").select(F.unix_date(F.to_date("ts")).alias("day"), (F.col("t") % 86400).alias("t"), (F.col("i") == "view").cast("int").alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "k"])
        _, alpha, _ = excite.fit_em(pdf["t"].to_numpy(), pdf["k"].to_numpy(), 2, 86400.0, np.array([1 / 3600]), 3600.0, most=20)
        return pd.DataFrame({"day": [int(pdf["day"].iloc[0])], "mass": [float(alpha.sum())]})

    # What a replicate draws are whole days, so a day is fitted once, by a task of its own; a replicate weighs the fits.
    fitted = e.groupBy("day").applyInPandas(run, "day int, mass double")
    drawn = fitted.crossJoin(F.broadcast(s.range(20).withColumnRenamed("id", "rep"))).withColumn("w", resample.poisson1(resample.unit(9, F.col("rep"), F.col("day"))))
    w = F.sum("w").cast("double")
    return drawn.where("w > 0").groupBy("rep").agg(w.alias("weight"), (F.sum(F.col("w") * F.col("mass")) / F.greatest(w, F.lit(1.0))).alias("mass"))


def ex23(s, d):
    """How many events of each kind an event gives rise to, as the posterior has it."""
    p = an._posterior(s, d).where("source IS NOT NULL").groupBy("j").agg(F.sum("prob").alias("mass"))
    n = _ev(s, d).groupBy(F.col("event_type").alias("j")).agg(F.count("*").alias("n"))
    return n.join(p, "j", "left").select("j", "n", F.round(F.coalesce("mass", F.lit(0.0)) / F.col("n"), R).alias("children"))


def ex25(s, d):
    """Pairs under other reaches."""
    reach = s.createDataFrame([(3600.0,), (7200.0,), (21600.0,)], "reach double")  # three variants
    p = an._pairs(s, d).crossJoin(F.broadcast(reach)).where("dt <= reach")
    return p.groupBy("reach").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


# ---------------------------------------------------------------- survival


def _versions(s, d):
    rel = materialize(survive.relations(table(s, d, "documents"), "source", "doc_id", "text"), "relations")
    return materialize(survive.lineage(rel), "lineage")


def sv02(s, d):
    """Generations of versions: a rewrite begins one, which comes from that of the row before."""
    return _versions(s, d).select(F.col("id").alias("doc_id"), "gen", "depth", "parent", "input")


def sv03(s, d):
    """All columns of versions, with the regime: from a source's first long document on (less five ids) it is another."""
    first = table(s, d, "documents").where("n_chars > 4000").groupBy(F.col("source").alias("by")).agg((F.min("doc_id") - 5).alias("first"))
    after = F.coalesce(F.col("id") >= F.col("first"), F.lit(False))
    got = _versions(s, d).join(first, "by", "left")
    return got.select(F.col("id").alias("doc_id"), F.col("by").alias("source"), "prev", "rel", "base", F.col("base_lag").cast("long").alias("base_lag"), F.col("rel").isin(*survive.GENERATIONS).alias("is_generation"), "gen", "depth", "parent", "input", F.when(after, "post").otherwise("pre").alias("regime"))


def sv04(s, d):
    """Versions that count: no repeats, and none of generations that nothing later descends from."""
    return survive.live_rows(_versions(s, d)).select(F.col("id").alias("doc_id"), "rel", "gen")


SV04 = an.LINEAGE + """,
     live AS (SELECT arg_max(gen, k) AS gen FROM l GROUP BY source UNION SELECT t.parent FROM t JOIN live ON t.doc_id = live.gen WHERE t.parent IS NOT NULL)
SELECT doc_id, rel, gen FROM l WHERE rel <> 'ident' AND gen IN (SELECT gen FROM live)"""


def sv05(s, d):
    """Ids of values: dense ranks within their kind."""
    v = _ev(s, d).select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).distinct()
    return v.select("event_type", "k", F.dense_rank().over(W.partitionBy("event_type").orderBy("k")).alias("vid"))


def sv06(s, d):
    """What became of each user's presence from day to day: kept, dropped, restored, entered."""
    x = an._days(s, d).distinct()
    w = W.partitionBy("user_id").orderBy("day")
    y = x.withColumn("p", F.lag("day").over(w)).withColumn("n", F.lead("day").over(w))
    came = y.select("user_id", "day", F.when(F.col("p").isNull(), "entered").when(F.col("p") == F.col("day") - 1, "kept").otherwise("restored").alias("fate"))
    went = y.where("n IS NULL OR n > day + 1").where("day < 29").select("user_id", (F.col("day") + 1).alias("day"), F.lit("dropped").alias("fate"))
    return came.unionByName(went).groupBy("day", "fate").agg(F.count("*").alias("n"))


SV06 = """
WITH x AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day FROM events),
     y AS (SELECT *, lag(day) OVER w AS p, lead(day) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT day, fate, count(*) AS n FROM (SELECT day, CASE WHEN p IS NULL THEN 'entered' WHEN p = day - 1 THEN 'kept' ELSE 'restored' END AS fate FROM y
  UNION ALL SELECT day + 1, 'dropped' FROM y WHERE (n IS NULL OR n > day + 1) AND day < 29) GROUP BY 1, 2"""


def sv13(s, d):
    """Simulated lifetimes: the hazard of each trial is the same, so survival falls by it."""
    n = s.range(20000).select(resample.unit(4, F.col("id")).alias("u")).select(F.ceil(F.log(1 - F.col("u")) / F.log(F.lit(0.8))).cast("long").alias("g"))
    return n.select(F.greatest("g", F.lit(1)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


def sv16(s, d):
    """Spells under two rules of presence: any row, and two rows or more."""
    n = _ev(s, d).groupBy("user_id", _day().alias("day")).agg(F.count("*").alias("n"))
    a = survive.presence_spells(n, ["user_id"], "day").groupBy("user_id").agg(F.count("*").alias("any"))
    b = survive.presence_spells(n.where("n >= 2"), ["user_id"], "day").groupBy("user_id").agg(F.count("*").alias("two"))
    return a.join(b, "user_id", "full").select("user_id", F.coalesce("any", F.lit(0)).alias("any"), F.coalesce("two", F.lit(0)).alias("two"))


SV16 = """
WITH n AS (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day, count(*) AS n FROM events GROUP BY 1, 2),
     a AS (SELECT user_id, count(DISTINCT i) AS c FROM (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM n) GROUP BY 1),
     b AS (SELECT user_id, count(DISTINCT i) AS c FROM (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM n WHERE n >= 2) GROUP BY 1)
SELECT user_id, coalesce(a.c, 0) AS any, coalesce(b.c, 0) AS two FROM a FULL JOIN b USING (user_id)"""


# ---------------------------------------------------------------- transmission


def tr01(s, d):
    """Units with three occurrences or more, by two actors or more, and at most forty."""
    return an._occ(s, d).groupBy("unit").agg(F.count("*").alias("n"), F.countDistinct("actor").alias("actors"), F.min("day").alias("first")).where("n BETWEEN 3 AND 30 AND actors >= 2")


def tr03(s, d):
    g = table(s, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    return g.groupBy("conv_id", "w").agg(F.min("turn").alias("first"), F.max("turn").alias("last")).where("last > first").groupBy("conv_id").agg(F.count("*").alias("held"), F.max(F.col("last") - F.col("first")).alias("longest"))


def tr08(s, d):
    """Values of a unit that its first occurrence did not have."""
    o = table(s, d, "lineitem").select(F.col("l_partkey").alias("unit"), "l_shipdate", "l_orderkey", F.col("l_suppkey").alias("v"))
    first = o.groupBy("unit").agg(F.min(F.struct("l_shipdate", "l_orderkey", "v")).alias("f")).select("unit", F.col("f.v").alias("v"))
    return o.select("unit", "v").distinct().join(first, ["unit", "v"], "left_anti").groupBy("unit").agg(F.count("*").alias("n"))


def drawn(s, d):
    """(draw, child, parent, dt): the candidates of the parent that each draw takes."""
    w = W.partitionBy("child").orderBy("parent").rowsBetween(W.unboundedPreceding, 0)
    # A child's rows come together once: sums run along its parents, and a draw takes the first that is over its number.
    c = an._post(s, d).withColumn("cum", F.sum("post").over(w))
    x = c.crossJoin(F.broadcast(s.range(5).withColumnRenamed("id", "draw"))).withColumn("u", resample.unit(11, F.col("draw"), F.col("child")))  # five draws
    took = F.min(F.when((F.col("cum") > F.col("u")) | (F.col("cum") > 1 - 1e-9), F.col("parent"))).over(W.partitionBy("child", "draw"))
    return x.withColumn("took", took).where("parent = took").select("draw", "child", "parent", "dt")


def tr13(s, d):
    """A parent drawn for each child from its posterior, in five draws."""
    return drawn(s, d).select("draw", "child", "parent").distinct()


TR13 = an.POST + f""",
     q AS (SELECT child, parent, dt, sum(post) OVER (PARTITION BY child ORDER BY parent ROWS UNBOUNDED PRECEDING) AS cum FROM p),
     w AS (SELECT draw, child, min(parent) AS parent FROM q, range(5) t(draw) WHERE cum > {resample.unit_sql(11, "draw", "child")} OR cum > 1 - 1e-9 GROUP BY 1, 2)
SELECT draw, child, parent FROM w"""


def tr15(s, d):
    """Of each unit and actor, the first occurrence owns the rest."""
    o = an._occ(s, d)
    own = o.groupBy("unit", "actor").agg(F.min(F.struct("day", "occ")).alias("f"))
    return o.join(own, ["unit", "actor"]).select("occ", F.col("f.occ").alias("owner"), (F.col("day") - F.col("f.day")).alias("after"))


def tr19(s, d):
    """Weighted line through the mean interval by number of candidates."""
    k = an._cand(s, d).groupBy("child").agg(F.count("*").alias("k"), F.avg("dt").alias("t"))
    g = k.groupBy("k").agg(F.count("*").cast("double").alias("w"), F.avg("t").alias("t"))
    m = g.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("k")).alias("x"), F.sum(F.col("w") * F.col("t")).alias("y"), F.sum(F.col("w") * F.col("k") * F.col("k")).alias("xx"), F.sum(F.col("w") * F.col("k") * F.col("t")).alias("xy"))
    return m.select(F.round((F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x")), R).alias("slope"))


def tr21(s, d):
    """Whether quantity changes from parent to child, by distance."""
    q = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("occ"), F.col("l_quantity").alias("q")).dropDuplicates(["occ"])
    b = transmit.likeliest(an._post(s, d))
    x = b.join(q.select(F.col("occ").alias("child"), "q"), "child").join(q.select(F.col("occ").alias("parent"), F.col("q").alias("p")), "parent")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("q") != F.col("p")).alias("changed"))


def tr23(s, d):
    """How often the likeliest parent is the nearest, for several weights of distance."""
    gammas = (0.0, 0.1, -0.3)
    weigh = lambda g: F.round(-F.log(F.col("dt").cast("double")) - g * F.col("dt"), 9)
    best = (F.max(F.struct(weigh(g).alias("w"), "parent", "dt")).alias(f"b{k}") for k, g in enumerate(gammas))
    # A row for each child, whatever the number of weights; candidates are combined before they are shuffled.
    c = an._cand(s, d).groupBy("child").agg(F.min("dt").alias("near"), *best)
    x = c.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gamma"), (F.col(f"b{k}.dt") == F.col("near")).alias("hit")) for k, g in enumerate(gammas)))).alias("x"))
    return x.groupBy("x.gamma").agg(F.count("*").alias("n"), F.count_if("x.hit").alias("nearest"))


TR23 = an.CAND + """
SELECT gamma, count(*) AS n, count(*) FILTER (dt = near) AS nearest FROM (SELECT gamma, dt, min(dt) OVER (PARTITION BY gamma, child) AS near,
  row_number() OVER (PARTITION BY gamma, child ORDER BY round(-ln(dt) - gamma * dt, 9) DESC, parent DESC) AS k FROM c, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (-0.3::DOUBLE)) v(gamma)) WHERE k = 1 GROUP BY 1"""


# ---------------------------------------------------------------- change points


def cp07(s, d):
    """Means of each series before and after the middle of the month, and their ratio."""
    x = an._series(s, d).withColumn("seg", (F.col("day") >= 15).cast("int"))
    return x.groupBy("series").agg(F.round(F.avg(F.when(F.col("seg") == 0, F.col("x"))), R).alias("before"), F.round(F.avg(F.when(F.col("seg") == 1, F.col("x"))), R).alias("after"))


def cp08(s, d):
    """Welch's statistic of users active on both sides."""
    x = _ev(s, d).groupBy("event_type", "user_id").agg(F.count_if(_day() < 15).alias("a"), F.count_if(_day() >= 15).alias("b")).where("a > 0 AND b > 0")
    g = x.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"))
    return g.select("event_type", "n", F.round((F.col("mb") - F.col("ma")) / F.sqrt((F.col("va") + F.col("vb")) / F.col("n")), R).alias("t"))


def cp12(s, d):
    """The alignment statistic with points placed anew, uniformly."""
    days = an._entries(s).select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("at")).distinct()
    n = an._points(s, d).select(F.row_number().over(W.orderBy("at")).alias("k"))  # a row for each kind and date
    x = n.crossJoin(F.broadcast(s.range(200).withColumnRenamed("id", "rep"))).withColumn("at", F.floor(resample.unit(6, F.col("rep"), F.col("k")) * 30).cast("int"))
    return x.join(F.broadcast(days), "at", "left_semi").groupBy("rep").agg(F.count("*").alias("s"))


CP12 = an.POINTS + f""",
     k AS (SELECT row_number() OVER (ORDER BY pt.at) AS k FROM pt), dy AS (SELECT DISTINCT unnest(range(lo - 1, hi + 2)) AS at FROM en),
     z AS (SELECT rep, CAST(floor({resample.unit_sql(6, "rep", "k")} * 30) AS INT) AS at FROM k, range(200) t(rep))
SELECT rep, count(*) AS s FROM z WHERE z."at" IN (SELECT dy."at" FROM dy) GROUP BY 1"""


def cp15(s, d):
    """Intervals once each, with the groups that have them."""
    x = an.sv08(s, d).select("start", "end", (F.col("user_id") % 4).alias("grp"))
    return x.groupBy("start", "end").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("grp")), lambda g: g.cast("string")), ",").alias("groups"))


def cp17(s, d):
    """The longest stretch of each user's days without a gap of over two."""
    x = an._days(s, d).distinct()
    w = W.partitionBy("user_id").orderBy("day")
    y = x.withColumn("new", F.when(F.col("day") - F.lag("day").over(w) <= 2, 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = y.groupBy("user_id", "k").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return r.groupBy("user_id").agg(F.max(F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("a")).alias("m"))).alias("x")).select("user_id", (-F.col("x.m")).alias("start"), F.col("x.n").alias("days"))


CP17 = """
WITH x AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day FROM events),
     y AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 2 THEN 0 ELSE 1 END AS f FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day)),
     k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS k FROM y),
     r AS (SELECT user_id, min(day) AS a, max(day) AS b FROM k GROUP BY user_id, k)
SELECT user_id, a AS start, b - a AS days FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, a) = 1"""


def cp18(s, d):
    """Points with the entries within two days."""
    near = s.range(4).select(F.col("id").alias("entry"), F.explode(F.sequence((F.col("id") * 7).cast("int"), (F.col("id") * 7 + 4 + F.col("id") % 2).cast("int"))).alias("at"))
    return an._points(s, d).groupBy("at").agg(F.count("*").alias("n")).join(F.broadcast(near), "at").select("at", "entry", "n")  # four entries


# ---------------------------------------------------------------- graphs and validation


def dg06(s, d):
    """Edges inside one half-year, and those that cross."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.quarter("o_orderdate").alias("q"))
    e = an._edges(s, d).join(o.select(F.col("k").alias("who"), F.col("q").alias("a")), "who").join(o.select(F.col("k").alias("parent"), F.col("q").alias("b")), "parent")
    return e.groupBy("a", (F.col("a") == F.col("b")).alias("inside")).agg(F.count("*").alias("n"))


def dg08(s, d):
    """How often a customer's next order has a part of the one before."""
    o = table(s, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b IS NOT NULL")
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k")).distinct()
    hit = nxt.join(li.withColumnRenamed("l_orderkey", "a"), "a").join(li.withColumnRenamed("l_orderkey", "b"), ["b", "k"]).select("a").distinct().withColumn("hit", F.lit(1))
    return nxt.join(hit, "a", "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


DG08 = """
WITH n AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
     l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k FROM lineitem)
SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM l x JOIN l y ON x.k = y.k WHERE x.o = a AND y.o = b)) AS hits FROM n WHERE b IS NOT NULL"""


def sim03(s, d):
    """Speedup by team size over simulated graphs, with the share that a team of four gains half of."""
    return an.QUERIES["SIM-02_teams"][0](s, d).groupBy("n_agents").agg(F.count("*").alias("n"), F.round(F.avg("speedup"), 4).alias("speedup"), F.round(F.avg((F.col("speedup") > 2).cast("double")), 4).alias("over_two"))


def va05(s, d):
    """What share of a nation's order value its largest customer has."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    x = table(s, d, "customer").join(o, "c_custkey")
    return x.groupBy("c_nationkey").agg(F.round(F.max("v") / F.sum("v"), R).alias("share"))


def va07(s, d):
    """A review sample of three documents for each language and label, with its inclusion probability."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    r = F.sha2(F.concat_ws("\0", F.lit("review"), F.col("doc_id").cast("string")), 256)
    w = W.partitionBy("lang", "quality")
    y = x.withColumn("k", F.row_number().over(w.orderBy(r, "doc_id"))).withColumn("n", F.count("*").over(w)).where("k <= 3")
    return y.select("lang", "quality", "k", "doc_id", F.round(F.least(F.lit(1.0), 3 / F.col("n")), R).alias("p"))


def va12(s, d):
    """Weighted Gini of balances, by nation; weights are one for each order."""
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("w"))
    x = table(s, d, "customer").join(n, "c_custkey").where("c_acctbal > 0")
    w = W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    y = x.withColumn("b", F.coalesce(F.sum("w").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("w").over(W.partitionBy("c_nationkey")))
    num = F.sum(F.col("w") * F.col("c_acctbal") * (2 * F.col("b") + F.col("w") - F.col("all")))
    return y.groupBy("c_nationkey").agg(F.round(num / (F.max("all") * F.sum(F.col("w") * F.col("c_acctbal"))), R).alias("gini"))


VA12 = """
WITH x AS (SELECT c_nationkey, c_acctbal AS v, c_custkey, count(*) AS w FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1, 2, 3),
     y AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY c_nationkey ORDER BY v, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(w) OVER (PARTITION BY c_nationkey) AS a FROM x)
SELECT c_nationkey, round(sum(w * v * (2 * b + w - a)) / (max(a) * sum(w * v)), 6) AS gini FROM y GROUP BY 1"""


def va13(s, d):
    """Which length rule agrees best with the quality labels, by language."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    r = x.crossJoin(F.broadcast(s.createDataFrame([(100,), (300,), (800,)], "rule int")))  # three rules
    g = r.groupBy("lang", "rule").agg(F.round(F.avg(((F.col("n_chars") > F.col("rule")).cast("int") == F.col("quality")).cast("double")), R).alias("agree"))
    return g.groupBy("lang").agg(F.max(F.struct("agree", "rule")).alias("m")).select("lang", "m.rule", "m.agree")


VA13 = """
WITH g AS (SELECT lang, rule, round(avg(CAST(CAST(n_chars > rule AS INT) = quality AS INT)), 6) AS agree FROM labels JOIN documents USING (doc_id), (VALUES (100), (300), (800)) v(rule) GROUP BY 1, 2)
SELECT lang, rule, agree FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY agree DESC, rule DESC) = 1"""

DAYS = "SELECT user_id, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS day, event_type, event_id, ts FROM events"

QUERIES = {
    "JN-17_channels": (jn17, JN17),
    "JN-21_container_writers": (jn21, JN21),
    "W-09_latest_other": (w09, W09),
    "W-13_decayed_counts": (w13, f"SELECT event_id AS target, round(coalesce(x, 0), 6) AS decayed FROM events LEFT JOIN (SELECT target, sum(exp(-dt / 3600)) AS x FROM ({an.PAIRS}) GROUP BY 1) ON target = event_id"),
    "W-16_compensator": (w16, W16),
    "PRJ-15_masks": (prj15, f"WITH x AS ({DAYS}) SELECT user_id, count(*) FILTER (day < 10) AS early, count(*) FILTER (day + 7 <= m) AS forward FROM (SELECT *, max(day) OVER (PARTITION BY user_id) AS m FROM x) GROUP BY 1"),
    "PRJ-16_private_columns": (prj16, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "AG-10_merge_windows": (ag10, None),
    "AG-16_hazards_by_month": (ag16, _risk_sql("start // 10") + " SELECT grp, g, round(lost / at_risk, 6) AS hazard FROM r WHERE at_risk >= 5"),
    "AG-17_before_after": (ag17, _risk_sql("CASE WHEN start < 15 THEN 'before' ELSE 'after' END", "start BETWEEN 10 AND 19") + " SELECT * FROM r"),
    "AG-18_second_spells": (ag18, _risk_sql("'second'", "spell = 2") + " SELECT * FROM r"),
    "AG-20_intervals": (ag20, TREE + "\nSELECT CAST(generation AS BIGINT) AS generation, count(*) AS n, round(avg(dt), 6) AS mean, quantile_cont(dt, 0.5) AS median FROM tr WHERE dt IS NOT NULL GROUP BY 1"),
    "AG-21_generations": (ag21, TREE + ",\n     k AS (SELECT tr.*, coalesce(n, 0) AS kids FROM tr LEFT JOIN (SELECT parent AS p, count(*) AS n FROM tr WHERE parent IS NOT NULL GROUP BY 1) ON p = node)\nSELECT CAST(generation AS BIGINT) AS generation, count(*) AS n, round(avg(kids), 6) AS offspring, round(avg(CAST(kids = 0 AS INT)), 6) AS childless FROM k GROUP BY 1"),
    "AG-22_restatements": (ag22, an.CAND.split(",\n     c AS")[0] + "\nSELECT least(n, 5) AS times, count(*) AS owners FROM (SELECT count(*) AS n FROM o GROUP BY unit, actor) GROUP BY 1"),
    "AG-24_siblings": (ag24, an.EDGES + ",\n     n AS (SELECT parent, count(DISTINCT who) AS n FROM e GROUP BY 1)\nSELECT count(*) AS parents, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs, max(n) AS widest FROM n"),
    "AG-27_coverage": (ag27, "WITH g AS (SELECT o_orderkey, o_orderpriority, max(CAST(l_returnflag = 'R' AS INT)) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS n, count(*) FILTER (r = 1) AS covered, round(avg(coalesce(r, 0)), 6) AS share FROM g GROUP BY 1"),
    "EX-04_pair_mass": (ex04, f"SELECT i, j, count(*) AS n, round(sum(prob), 4) AS mass FROM ({an.POSTERIOR}) WHERE source IS NOT NULL GROUP BY 1, 2"),
    "EX-11_bootstrap": (ex11, None),
    "EX-23_expected_children": (ex23, f"SELECT event_type AS j, count(*) AS n, round(coalesce(any_value(mass), 0) / count(*), 6) AS children FROM events LEFT JOIN (SELECT j, sum(prob) AS mass FROM ({an.POSTERIOR}) WHERE source IS NOT NULL GROUP BY 1) p ON p.j = event_type GROUP BY 1"),
    "EX-25_reach_variants": (ex25, f"SELECT reach, count(*) AS n, count(DISTINCT target) AS targets FROM ({an.PAIRS}), (VALUES (3600.0::DOUBLE), (7200.0::DOUBLE), (21600.0::DOUBLE)) v(reach) WHERE dt <= reach GROUP BY 1"),
    "SV-02_generations": (sv02, an.LINEAGE + "\nSELECT doc_id, gen, depth, parent, input FROM l"),
    "SV-03_versions": (sv03, an.LINEAGE + ",\n     f AS (SELECT source, min(doc_id) - 5 AS first FROM documents WHERE n_chars > 4000 GROUP BY 1)\nSELECT doc_id, l.source, prev, rel, base, base_lag, rel IN ('first', 'rewrite') AS is_generation, gen, depth, parent, input, CASE WHEN doc_id >= first THEN 'post' ELSE 'pre' END AS regime FROM l LEFT JOIN f ON f.source IS NOT DISTINCT FROM l.source"),
    "SV-04_live_rows": (sv04, SV04),
    "SV-05_value_ids": (sv05, "SELECT event_type, k, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY k) AS INT) AS vid FROM (SELECT DISTINCT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"),
    "SV-06_fates": (sv06, SV06),
    "SV-13_simulated": (sv13, f"SELECT greatest(CAST(ceil(ln(1 - {resample.unit_sql(4, 'id')}) / ln(0.8)) AS BIGINT), 1) AS g, count(*) AS n FROM range(20000) t(id) GROUP BY 1"),
    "SV-16_rule_comparison": (sv16, SV16),
    "TR-01_units": (tr01, an.CAND.split(",\n     c AS")[0] + "\nSELECT unit, count(*) AS n, count(DISTINCT actor) AS actors, min(day) AS first FROM o GROUP BY 1 HAVING count(*) BETWEEN 3 AND 30 AND count(DISTINCT actor) >= 2"),
    "TR-03_held_words": (tr03, "WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations), g AS (SELECT conv_id, w, min(turn) AS a, max(turn) AS b FROM w GROUP BY 1, 2 HAVING max(turn) > min(turn)) SELECT conv_id, count(*) AS held, max(b - a) AS longest FROM g GROUP BY 1"),
    "TR-08_new_values": (tr08, "WITH f AS (SELECT l_partkey AS unit, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_suppkey)) AS v FROM lineitem GROUP BY 1) SELECT l_partkey AS unit, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN f ON unit = l_partkey WHERE l_suppkey <> v GROUP BY 1"),
    "TR-13_drawn_parents": (tr13, TR13),
    "TR-15_owners": (tr15, an.CAND.split(",\n     c AS")[0] + "\nSELECT occ, first_value(occ) OVER w AS owner, day - first_value(day) OVER w AS after FROM o WINDOW w AS (PARTITION BY unit, actor ORDER BY day, occ)"),
    "TR-19_line": (tr19, an.CAND + ",\n     k AS (SELECT child, count(*) AS k, avg(dt) AS t FROM c GROUP BY 1), g AS (SELECT k, count(*) AS w, avg(t) AS t FROM k GROUP BY 1)\nSELECT round((sum(w) * sum(w * k * t) - sum(w * k) * sum(w * t)) / (sum(w) * sum(w * k * k) - sum(w * k) * sum(w * k)), 6) AS slope FROM g"),
    "TR-23_weights": (tr23, TR23),
    "CP-07_segment_means": (cp07, "WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) - DATE '2024-01-01' AS day, count(*) AS x FROM events GROUP BY 1, 2) SELECT series, round(avg(x) FILTER (day < 15), 6) AS before, round(avg(x) FILTER (day >= 15), 6) AS after FROM x GROUP BY 1"),
    "CP-08_stayers": (cp08, f"WITH x AS (SELECT event_type, user_id, count(*) FILTER (day < 15) AS a, count(*) FILTER (day >= 15) AS b FROM ({DAYS}) GROUP BY 1, 2) SELECT event_type, count(*) AS n, round((avg(b) - avg(a)) / sqrt((var_samp(a) + var_samp(b)) / count(*)), 6) AS t FROM x WHERE a > 0 AND b > 0 GROUP BY 1"),
    "CP-12_uniform_null": (cp12, CP12),
    "CP-15_layout": (cp15, f"SELECT start, \"end\", count(*) AS n, array_to_string(list_sort(list(DISTINCT user_id % 4)), ',') AS groups FROM ({an.SV08}) GROUP BY 1, 2"),
    "CP-17_coverage": (cp17, CP17),
    "CP-18_annotation": (cp18, an.POINTS + "\nSELECT pt.at, id AS entry, count(*) AS n FROM pt JOIN range(4) t(id) ON pt.at BETWEEN id * 7 AND id * 7 + 4 + id % 2 GROUP BY 1, 2"),
    "DG-06_inner_edges": (dg06, an.EDGES + "\nSELECT CAST(quarter(a.o_orderdate) AS INT) AS a, quarter(a.o_orderdate) = quarter(b.o_orderdate) AS inside, count(*) AS n FROM e JOIN orders a ON a.o_orderkey = who JOIN orders b ON b.o_orderkey = parent GROUP BY 1, 2"),
    "DG-08_continuation": (dg08, DG08),
    "SIM-03_speedup": (sim03, None),
    "VA-05_partner_share": (va05, "SELECT c_nationkey, round(max(v) / sum(v), 6) AS share FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"),
    "VA-07_review_design": (va07, "SELECT lang, quality, CAST(row_number() OVER (PARTITION BY lang, quality ORDER BY sha256('review' || chr(0) || doc_id), doc_id) AS INT) AS k, doc_id, round(least(1, 3 / count(*) OVER (PARTITION BY lang, quality)), 6) AS p FROM labels JOIN documents USING (doc_id) QUALIFY k <= 3"),
    "VA-12_weighted_gini": (va12, VA12),
    "VA-13_best_rule": (va13, VA13),
}
