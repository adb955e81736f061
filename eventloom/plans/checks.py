"""Second phases of fits, selection and made truths; alignment of versions; designs and audits; streams of writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.functions import text as ft
from eventloom.operators import excite, fits, pointfit, resample, shift, stats, swarm
from eventloom.plans import analysis as an
from eventloom.session import table
from eventloom.shared import materialize, shared_dir
from eventloom.streaming import live

R = 6
BETAS, REACH = np.array([1 / 600, 1 / 3600]), 3600.0
KINDS = ("click", "error", "purchase", "signup", "view")


def _ev(s, d, kind=None):
    e = table(s, d, "events")
    return e if kind is None else e.where(F.col("event_type") == kind)


# ---------------------------------------------------------------- excitation


def _weeks(s, d):
    """Events with their week, day, time of day and kind."""
    day = F.unix_date(F.to_date("ts"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    return _ev(s, d).select(F.floor((day - F.lit(19723)) / 10).cast("long").alias("win"), day.cast("long").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - day * 86400).alias("t"), kind.cast("int").alias("k"))


def _designs(pdf: pd.DataFrame) -> list[pointfit.Design]:
    return [pointfit.design(x["t"].to_numpy(), x["k"].to_numpy(), len(KINDS), 86400.0, BETAS, REACH) for _, x in pdf.sort_values(["day", "t"]).groupby("day")]


def _by_window(s, d, f, schema: str) -> DataFrame:
    """f of each window's designs, one for each of its days. A window's events are one task's, ten numbers for each."""
    rows = _weeks(s, d)
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(4 * parts, "win").groupBy("win").applyInPandas(lambda pdf: f(int(pdf["win"].iloc[0]), _designs(pdf)), schema)


def ex08(s, d):
    """Each window's fit after Newton's phase, and how much likelihood any other could add."""

    def run(win: int, parts: list) -> pd.DataFrame:
        whole = pointfit.together(parts)
        first = pointfit.fit(whole, tol=1e-6, most=200)
        second, gap = pointfit.newton(whole, first)
        return pd.DataFrame({"win": [win], "n": [len(whole.kind)], "first": [round(first.loglik, 4)], "second": [round(second.loglik, 4)], "gap": [gap]})

    return _by_window(s, d, run, "win long, n long, first double, second double, gap double")


def ex09(s, d):
    """Each window's fit by how kernels are shared, from three starts."""

    def run(win: int, parts: list) -> pd.DataFrame:
        whole, rows = pointfit.together(parts), []
        for sharing in ("cell", "class", "global"):
            f, spread = pointfit.multi_start(whole, sharing, 3, win, tol=1e-7, most=200)
            rho = float(np.abs(np.linalg.eigvals(f.branching(BETAS, REACH))).max())
            rows.append((win, sharing, f.loglik, spread, rho))
        return pd.DataFrame(rows, columns=["win", "sharing", "loglik", "spread", "rho"])

    return _by_window(s, d, run, "win long, sharing string, loglik double, spread double, rho double")


def ex14(s, d):
    """Penalties by how well days that were held out are told; the best of each window is marked."""

    def run(win: int, parts: list) -> pd.DataFrame:
        got = pd.DataFrame(pointfit.held_out(parts, [0.0, 1.0, 10.0, 100.0]), columns=["penalty", "held_out"])
        return got.assign(win=win, best=got["held_out"] == got["held_out"].max())

    return _by_window(s, d, run, "win long, penalty double, held_out double, best boolean")


def ex16(s, d):
    """Arms of truths matched to one fit: simulated, fitted again, and the mean branching of a kind to itself found and true."""
    mu, n, beta, length = np.array([0.4, 0.2, 0.1]), np.array([[0.3, 0.1, 0.0], [0.1, 0.4, 0.1], [0.0, 0.2, 0.2]]), 1.0, 1500.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for task in pdf["id"].tolist():
                name = ("fitted", "no_self", "boosted_self")[task % 3]
                m, b = pointfit.arm(mu, n, name)
                t, k, _ = excite.simulate(np.random.default_rng([16, task]), m, b, beta, length)
                f = pointfit.fit(pointfit.design(t, k, 3, length, np.array([beta]), 12.0), tol=1e-6)
                rows.append((name, task // 3, len(t), float(pointfit.expected_counts(m, b, length).sum()), float(np.diag(f.alpha[:, :, 0]).mean()), float(np.diag(b).mean())))
            yield pd.DataFrame(rows, columns=["arm", "rep", "n", "expected", "found", "true"])

    return s.range(18).mapInPandas(run, "arm string, rep long, n long, expected double, found double, true double")


def ex17(s, d):
    """Made truths of a given spectral radius, with the events that one realization has and that it should have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seed in pdf["id"].tolist():
                rng = np.random.default_rng([17, seed])
                radius = 0.2 + 0.1 * (seed % 6)
                mu, n = pointfit.truth(rng, 4, radius, 0.5)
                t, _, _ = excite.simulate(rng, mu, n, 1.0, 500.0)
                rows.append((seed, radius, float(np.abs(np.linalg.eigvals(n)).max()), len(t), float(pointfit.expected_counts(mu, n, 500.0).sum())))
            yield pd.DataFrame(rows, columns=["seed", "asked", "radius", "n", "expected"])

    return s.range(24).mapInPandas(run, "seed long, asked double, radius double, n long, expected double")


def ex21(s, d):
    """Blocks of kinds that excite each other, in each window's branching matrix, and the means within and between them."""

    def run(win: int, parts: list) -> pd.DataFrame:
        n = pointfit.fit(pointfit.together(parts), tol=1e-6, most=200).branching(BETAS, REACH)
        at = pointfit.spectral_blocks(n, 2, seed=win)
        means = pointfit.block_means(n, at)
        return pd.DataFrame({"win": win, "kind": KINDS, "block": at, "inside": [means[b, b] for b in at], "between": [means[b, 1 - b] if len(means) > 1 else 0.0 for b in at]})

    return _by_window(s, d, run, "win long, kind string, block int, inside double, between double")


def ex22(s, d):
    """Days of each window, merged until each has rows enough and a fit that does not explode."""

    def run(win: int, parts: list) -> pd.DataFrame:
        rows = [(win, a, b, sum(len(p.kind) for p in parts[a : b + 1]), f.loglik) for a, b, f in pointfit.accept(parts, 700, 1.0, BETAS, REACH)]
        return pd.DataFrame(rows, columns=["win", "first", "last", "n", "loglik"])

    return _by_window(s, d, run, "win long, first int, last int, n long, loglik double")


# ---------------------------------------------------------------- versions and survival


def sv07(s, d):
    """What became of the lines of each document in the next one of its source: kept, replaced or gone."""
    docs = table(s, d, "documents").select("doc_id", "source", "text")
    pairs = docs.select("doc_id", "source", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next_id")).where("next_id IS NOT NULL")
    both = pairs.join(docs.select("doc_id", F.col("text").alias("a")), "doc_id").join(docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("b")), "next_id")

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b):
            x, y = (x or "").split("\n"), (y or "").split("\n")
            to = fits.line_changes(x, y)
            same = sum(k is not None and y[k] == line for k, line in zip(to, x))
            out.append((same, sum(k is not None for k in to) - same, sum(k is None for k in to)))
        return pd.DataFrame(out, columns=["kept", "replaced", "gone"])

    changed = F.pandas_udf(run, "kept int, replaced int, gone int")
    return both.select("doc_id", "next_id", changed("a", "b").alias("x")).select("doc_id", "next_id", "x.*")


SPELLS = f'SELECT user_id, "end" - start + 1 AS last, "end" < 29 AS lost FROM ({an.SV08})'


def sv11(s, d):
    """Whether hazards at the first trial and later are alike: the log of their ratio over its spread in 200 bootstraps of users."""
    u = an.sv08(s, d).select("user_id", (F.col("end") - F.col("start") + 1).alias("last"), (F.col("end") < 29).cast("int").alias("lost"))
    # Of each user: trials and losses, at the first trial and later.
    c = u.groupBy("user_id").agg(F.count("*").alias("n1"), F.sum(F.when(F.col("last") == 1, F.col("lost")).otherwise(0)).alias("d1"), F.sum(F.col("last") - 1).alias("n2"), F.sum(F.when(F.col("last") > 1, F.col("lost")).otherwise(0)).alias("d2"))
    ratio = lambda w: F.log(((F.sum(w * F.col("d1")) + 0.5) / (F.sum(w * F.col("n1")) + 1)) / ((F.sum(w * F.col("d2")) + 0.5) / (F.sum(w * F.col("n2")) + 1)))
    drawn = c.crossJoin(F.broadcast(s.range(200).withColumnRenamed("id", "rep"))).withColumn("w", resample.poisson1(resample.unit(21, F.col("rep"), F.col("user_id"))))  # a stated number of replicates
    spread = drawn.groupBy("rep").agg(ratio(F.col("w")).alias("x")).agg(F.stddev_samp("x").alias("se"))
    return c.agg(F.count("*").alias("clusters"), ratio(F.lit(1)).alias("est")).crossJoin(spread).select("clusters", F.round("est", R).alias("log_ratio"), F.round("se", R).alias("se"), F.round(F.pow(F.col("est") / F.col("se"), 2), 4).alias("wald"))


SV11 = f"""
WITH c AS (SELECT user_id, count(*) AS n1, sum(CASE WHEN last = 1 AND lost THEN 1 ELSE 0 END) AS d1, sum(last - 1) AS n2, sum(CASE WHEN last > 1 AND lost THEN 1 ELSE 0 END) AS d2 FROM ({SPELLS}) GROUP BY 1),
     w AS (SELECT c.*, rep, {resample.poisson1_sql(resample.unit_sql(21, "rep", "user_id"))} AS w FROM c, range(200) t(rep)),
     b AS (SELECT ln(((sum(w * d1) + 0.5) / (sum(w * n1) + 1)) / ((sum(w * d2) + 0.5) / (sum(w * n2) + 1))) AS x FROM w GROUP BY rep),
     e AS (SELECT count(*) AS clusters, ln(((sum(d1) + 0.5) / (sum(n1) + 1)) / ((sum(d2) + 0.5) / (sum(n2) + 1))) AS est FROM c)
SELECT clusters, round(est, 6) AS log_ratio, round(se, 6) AS se, round(pow(est / se, 2), 4) AS wald FROM e, (SELECT stddev_samp(x) AS se FROM b)"""


def sv14(s, d):
    """Of purchases' share in rows: an interval by a bootstrap of users where a scope has thirty or more, else Wilson's."""
    e = _ev(s, d).select(F.when(F.col("user_id") % 10 == 0, "tenth").when(F.col("user_id") < 20, "few").otherwise("rest").alias("scope"), "user_id", (F.col("event_type") == "purchase").cast("double").alias("x"))
    c = e.groupBy("scope", "user_id").agg(F.sum("x").alias("num"), F.count("*").cast("double").alias("den"))
    n = c.groupBy("scope").agg(F.count("*").alias("clusters"), F.sum("num").alias("x"), F.sum("den").alias("n"))
    wide = resample.bootstrap_ratio(c, ["scope"], "user_id", "num", "den", 100, seed=14)
    many = F.col("clusters") >= 30
    ends = stats.wilson(F.col("x"), F.col("n"))
    return n.join(wide, "scope").select("scope", "clusters", F.round(F.col("x") / F.col("n"), R).alias("share"), F.when(many, "bootstrap").otherwise("wilson").alias("by"), F.round(F.when(many, F.col("lo")).otherwise(ends[0]), R).alias("lo"), F.round(F.when(many, F.col("hi")).otherwise(ends[1]), R).alias("hi"))


SV14 = f"""
WITH c AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'tenth' WHEN user_id < 20 THEN 'few' ELSE 'rest' END AS scope, user_id, sum(CAST(event_type = 'purchase' AS INT)) AS num, count(*) AS den FROM events GROUP BY 1, 2),
     n AS (SELECT scope, count(*) AS clusters, sum(num) AS x, sum(den) AS n FROM c GROUP BY 1),
     w AS (SELECT c.*, rep, {resample.poisson1_sql(resample.unit_sql(14, "rep", "user_id"))} AS w FROM c, range(100) t(rep)),
     b AS (SELECT scope, rep, sum(w * num) / nullif(sum(w * den), 0) AS r FROM w GROUP BY 1, 2),
     e AS (SELECT scope, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM b GROUP BY 1),
     z AS (SELECT n.*, e.lo, e.hi, 1.959963984540054 AS z, CAST(x AS DOUBLE) / n AS p FROM n JOIN e USING (scope))
SELECT scope, clusters, round(p, 6) AS share, CASE WHEN clusters >= 30 THEN 'bootstrap' ELSE 'wilson' END AS by,
       round(CASE WHEN clusters >= 30 THEN lo ELSE (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) END, 6) AS lo,
       round(CASE WHEN clusters >= 30 THEN hi ELSE (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) END, 6) AS hi FROM z"""


# ---------------------------------------------------------------- transmission


def tr05(s, d):
    """Of each turn: words, different quantities, and 4-grams of words that at most two turns have."""
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    rows = c.select("conv_id", "turn", F.size(ft.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))).cast("long").alias("quantities"))
    grams = c.select("conv_id", "turn", F.explode(F.array_distinct(ft.grams(F.col("text"), 4))).alias("g"))
    rare = grams.join(grams.groupBy("g").agg(F.count("*").alias("n")).where("n <= 2"), "g").groupBy("conv_id", "turn").agg(F.count("*").alias("rare"))
    return rows.join(rare, ["conv_id", "turn"], "left").fillna(0, ["rare"])


TR05 = """
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?'))) AS BIGINT) AS quantities FROM conversations),
     g AS (SELECT DISTINCT conv_id, turn, array_to_string(w[k:k + 3], ' ') AS g FROM c, range(1, len(w) - 2) t(k) WHERE len(w) >= 4),
     r AS (SELECT conv_id, turn, count(*) AS rare FROM g WHERE g IN (SELECT g FROM g GROUP BY 1 HAVING count(*) <= 2) GROUP BY 1, 2)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS tokens, quantities, coalesce(rare, 0) AS rare FROM c LEFT JOIN r USING (conv_id, turn)"""


def tr21(s, d):
    """Between an order and the one that had its part before: values (quantities by line status) inherited, changed, new and lost."""
    e = materialize(an._edges(s, d), "edges")  # read twice
    v = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("who"), F.col("l_linestatus").alias("name")).agg(F.sum("l_quantity").alias("value"))
    child = e.join(v, "who").select("who", "parent", "key", "name", "value")
    parent = e.join(v.select(F.col("who").alias("parent"), "name", F.col("value").alias("was")), "parent").select("who", "parent", "key", "name", "was")
    both = child.join(parent, ["who", "parent", "key", "name"], "full")
    fate = F.when(F.col("was").isNull(), "new").when(F.col("value").isNull(), "lost").when(F.col("was") == F.col("value"), "inherited").otherwise("changed")
    return both.groupBy("name", fate.alias("fate")).agg(F.count("*").alias("n"))


TR21 = an.EDGES + """,
     v AS (SELECT l_orderkey AS who, l_linestatus AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
     h AS (SELECT e.*, v.name, v.value FROM e JOIN v USING (who)), q AS (SELECT e.*, v.name, v.value AS was FROM e JOIN v ON v.who = e.parent)
SELECT name, CASE WHEN was IS NULL THEN 'new' WHEN value IS NULL THEN 'lost' WHEN was = value THEN 'inherited' ELSE 'changed' END AS fate, count(*) AS n FROM h FULL JOIN q USING (who, parent, key, name) GROUP BY 1, 2"""


def tr26(s, d):
    """Made forests: how many parents the posterior finds, and how often a test of no difference says that there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep in pdf["id"].tolist():
                rng = np.random.default_rng([26, rep])
                n = 80
                t = np.sort(rng.uniform(0, 20, n))
                # Each but the first has a parent among those before, by a kernel of intervals; that kernel is the one that guesses.
                weight = np.where(t[None] < t[:, None], np.exp(-(t[:, None] - t[None])), 0)
                prob = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
                parent = np.array([-1, *(rng.choice(n, p=prob[i]) for i in range(1, n))])
                guess = np.concatenate([[-1], prob[1:].argmax(axis=1)])
                # Two groups that do not differ: intervals by permutation.
                dt = t[1:] - t[parent[1:]]
                group = rng.random(n - 1) < 0.5
                diff = lambda g: abs(dt[g].mean() - dt[~g].mean())
                own = diff(group)
                p = (1 + sum(diff(rng.permutation(group)) >= own - 1e-12 for _ in range(99))) / 100
                rows.append((rep, n, float((guess[1:] == parent[1:]).mean()), float(prob[np.arange(1, n), guess[1:]].mean()), p))
            yield pd.DataFrame(rows, columns=["rep", "n", "accuracy", "expected", "p"])

    return s.range(60).mapInPandas(run, "rep long, n long, accuracy double, expected double, p double")


def tr27(s, d):
    """Turns that quote: the latest earlier turn of the conversation with five words in a row of this one, where no earlier one has them too."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(ft.grams(F.col("text"), 5))).alias("g"))
    said = c.withColumn("said", F.lag("turn").over(W.partitionBy("conv_id", "g").orderBy("turn"))).withColumn("k", F.row_number().over(W.partitionBy("conv_id", "g").orderBy("turn")))
    # The second turn that has a phrase quotes the first; later ones may quote either.
    return said.where("k = 2").groupBy("conv_id", "turn").agg(F.max("said").alias("quotes"), F.count("*").alias("phrases"))


TR27 = """
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
     g AS (SELECT DISTINCT conv_id, turn, array_to_string(w[k:k + 4], ' ') AS g FROM c, range(1, len(w) - 3) t(k) WHERE len(w) >= 5),
     r AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id, g ORDER BY turn) AS said, row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS k FROM g)
SELECT conv_id, turn, max(said) AS quotes, count(*) AS phrases FROM r WHERE k = 2 GROUP BY 1, 2"""


# ---------------------------------------------------------------- change points


def cp03(s, d):
    """The bandwidth that a kernel cost takes for each series, and the variance of its values."""
    x = an._series(s, d)
    run = lambda pdf: pd.DataFrame({"series": [pdf["series"].iloc[0]], "gamma": [round(shift.bandwidth(pdf["x"].to_numpy(float)), 9)], "variance": [round(float(pdf["x"].var(ddof=0)), 6)]})
    return x.groupBy("series").applyInPandas(run, "series string, gamma double, variance double")


CP03 = """
WITH x AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2),
     m AS (SELECT a.series, quantile_cont((a.x - b.x) * (a.x - b.x), 0.5) AS m FROM x a JOIN x b ON a.series = b.series AND a.day < b.day GROUP BY 1)
SELECT series, round(CASE WHEN m > 0 THEN 1 / m ELSE 1 END, 9) AS gamma, round(var_pop(x), 6) AS variance FROM x JOIN m USING (series) GROUP BY 1, m"""


def cp06(s, d):
    """Every series of users (by tens) and kinds through one driver: whether it could be searched, and what each method finds."""
    daily = _ev(s, d).groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("series"), F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.count("*").alias("x"))
    return shift.series_summary(daily, "series", "day", "x")


def cp16(s, d):
    """Documented changes as run days: each entry begins on the first day at or after its date on which a signup was, and ends before the next of its kind."""
    days = _ev(s, d, "signup").where("value > 40").select(F.to_date("ts").alias("date")).distinct()
    run = days.withColumn("run_day", F.row_number().over(W.orderBy("date")))  # a row for each date
    entries = s.range(6).select(F.col("id").alias("entry"), F.when(F.col("id") % 2 == 0, "goal").otherwise("change").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 4).cast("int")).alias("date"))
    begin = entries.join(F.broadcast(run.withColumnRenamed("date", "run_date")), F.col("run_date") >= F.col("date"), "left").groupBy("entry", "kind", "date").agg(F.min("run_day").alias("first"))  # six entries by calendar days
    return begin.withColumn("last", F.lead("first").over(W.partitionBy("kind").orderBy("date")) - 1)


CP16 = """
WITH r AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS run_day FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_type = 'signup' AND value > 40)),
     e AS (SELECT id AS entry, CASE WHEN id % 2 = 0 THEN 'goal' ELSE 'change' END AS kind, DATE '2024-01-01' + CAST(id * 4 AS INT) AS date FROM range(6) t(id)),
     b AS (SELECT entry, kind, e.date, min(run_day) AS first FROM e LEFT JOIN r ON r.date >= e.date GROUP BY 1, 2, 3)
SELECT *, lead(first) OVER (PARTITION BY kind ORDER BY date) - 1 AS last FROM b"""


# ---------------------------------------------------------------- simulation


def sim04(s, d):
    """Where the observed shares of orders with several parents stand among those of generated graphs: mid-rank quantiles."""
    own = an.dg07(s, d).select(F.col("multi_share").alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for task in pdf["id"].tolist():
                parents, _, _ = swarm.grow(np.random.default_rng([4, task]), 80, 6, (0.1, 0.5, 0.9, 1.0)[task % 4])
                some = [len(p) for p in parents if p]
                rows.append((int(task % 4), float(np.mean([n > 1 for n in some]))))
            yield pd.DataFrame(rows, columns=["setting", "share"])

    made = s.range(200).mapInPandas(run, "setting int, share double")
    got = made.crossJoin(F.broadcast(own))  # one row
    return got.groupBy("setting", "own").agg(F.count("*").alias("n"), ((F.count_if(F.col("share") < F.col("own")) + 0.5 * F.count_if(F.col("share") == F.col("own"))) / F.count("*")).alias("quantile"))


def sim05(s, d):
    """What the simulator must do, checked: one agent is as fast as the sum of its steps; teams are never slower than the longest chain, nor faster than their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rep in pdf["id"].tolist():
                parents, layer, time = swarm.grow(np.random.default_rng([5, rep]), 100, 7, 0.3)
                alone = swarm.work(parents, layer, time, 1, overhead=0.0)[0]
                chain = np.zeros(len(parents))
                for i, ps in enumerate(parents):
                    chain[i] = time[i] + max((chain[p] for p in ps), default=0.0)
                for n in (2, 8, 1000):
                    span = swarm.work(parents, layer, time, n, overhead=0.0, talk=0.0)[0]
                    rows += [("no_faster_than_chain", span >= chain.max() - 1e-9), ("no_faster_than_team", span >= alone / n - 1e-9), ("no_slower_than_one", span <= alone + 1e-9)]
                rows += [("one_is_the_sum", bool(np.isclose(alone, time.sum()))), ("many_are_the_chain", bool(np.isclose(span, chain.max())))]
            yield pd.DataFrame(rows, columns=["check", "ok"])

    return s.range(50).mapInPandas(run, "check string, ok boolean").groupBy("check").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


# ---------------------------------------------------------------- validation


def va03(s, d):
    """Purchases' values on users' days with an error against days without: the difference within weekdays, weighted by flagged days, and its standard error."""
    day = _ev(s, d).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max((F.col("event_type") == "error").cast("int")).alias("flag"), F.avg("value").alias("x"))
    g = day.groupBy(F.weekday("date").alias("stratum")).agg(*(a for f in (0, 1) for a in (F.count_if(F.col("flag") == f).alias(f"n{f}"), F.avg(F.when(F.col("flag") == f, F.col("x"))).alias(f"m{f}"), F.var_samp(F.when(F.col("flag") == f, F.col("x"))).alias(f"v{f}"))))
    g = g.where("n0 >= 2 AND n1 >= 2")
    return g.agg(F.count("*").alias("strata"), F.sum("n1").alias("flagged"), F.round(F.sum(F.col("n1") * (F.col("m1") - F.col("m0"))) / F.sum("n1"), R).alias("effect"), F.round(F.sqrt(F.sum(F.col("n1") * F.col("n1") * (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")))) / F.sum("n1"), R).alias("se"))


VA03 = """
WITH y AS (SELECT user_id, CAST(ts AS DATE) AS date, max(CAST(event_type = 'error' AS INT)) AS flag, avg(value) AS x FROM events GROUP BY 1, 2),
     g AS (SELECT isodow(date) AS stratum, count(*) FILTER (flag = 0) AS n0, avg(x) FILTER (flag = 0) AS m0, var_samp(x) FILTER (flag = 0) AS v0, count(*) FILTER (flag = 1) AS n1, avg(x) FILTER (flag = 1) AS m1, var_samp(x) FILTER (flag = 1) AS v1 FROM y GROUP BY 1)
SELECT count(*) AS strata, CAST(sum(n1) AS BIGINT) AS flagged, round(sum(n1 * (m1 - m0)) / sum(n1), 6) AS effect, round(sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0))) / sum(n1), 6) AS se FROM g WHERE n0 >= 2 AND n1 >= 2"""


def va09(s, d):
    """Agreement of two labels beyond chance, with an interval by a bootstrap of documents."""
    x = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).cast("int").alias("a"), (F.col("toxic") == 0).cast("int").alias("b"))
    drawn = x.crossJoin(F.broadcast(s.range(100).withColumnRenamed("id", "rep"))).withColumn("w", resample.poisson1(resample.unit(9, F.col("rep"), F.col("doc_id"))))  # a stated number of replicates

    def kappa(w):
        n = F.sum(w)
        a, b = F.sum(w * F.col("a")) / n, F.sum(w * F.col("b")) / n
        seen = F.sum(w * (F.col("a") == F.col("b")).cast("int")) / n
        chance = a * b + (1 - a) * (1 - b)
        return (seen - chance) / (1 - chance)

    ends = drawn.groupBy("rep").agg(kappa(F.col("w")).alias("k")).agg(F.round(F.percentile("k", F.lit(0.025)), R).alias("lo"), F.round(F.percentile("k", F.lit(0.975)), R).alias("hi"))
    return x.agg(F.count("*").alias("n"), F.round(kappa(F.lit(1)), R).alias("kappa")).crossJoin(ends)


VA09 = f"""
WITH x AS (SELECT doc_id, CAST(quality = 1 AS INT) AS a, CAST(toxic = 0 AS INT) AS b FROM labels),
     w AS (SELECT x.*, rep, {resample.poisson1_sql(resample.unit_sql(9, "rep", "doc_id"))} AS w FROM x, range(100) t(rep)),
     m AS (SELECT rep, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b, sum(w * CAST(a = b AS INT)) / sum(w) AS s FROM w GROUP BY 1),
     o AS (SELECT count(*) AS n, avg(a) AS a, avg(b) AS b, avg(CAST(a = b AS INT)) AS s FROM x)
SELECT n, round((s - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa, lo, hi FROM o,
       (SELECT round(quantile_cont(k, 0.025), 6) AS lo, round(quantile_cont(k, 0.975), 6) AS hi FROM (SELECT (s - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) AS k FROM m))"""


def va10(s, d):
    """Labels to look at again: of each language and label ten by permanent random numbers, with the chance of each to be drawn; and what the rule of length gets right of all, so weighted."""
    x = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    w = W.partitionBy("lang", "quality")
    frame = x.withColumn("u", resample.unit(10, F.col("doc_id"))).withColumn("k", F.row_number().over(w.orderBy("u", "doc_id"))).withColumn("n", F.count("*").over(w))
    drawn = frame.where("k <= 10").withColumn("p", F.least(F.lit(1.0), 10 / F.col("n")))
    right = ((F.col("n_chars") > 300).cast("int") == F.col("quality")).cast("double")
    return drawn.groupBy("lang").agg(F.count("*").alias("drawn"), F.round(F.sum(1 / F.col("p")), R).alias("stands_for"), F.round(F.sum(right / F.col("p")) / F.sum(1 / F.col("p")), R).alias("accuracy"))


VA10 = f"""
WITH x AS (SELECT doc_id, lang, quality, n_chars, {resample.unit_sql(10, "doc_id")} AS u FROM labels JOIN documents USING (doc_id)),
     f AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY u, doc_id) AS k, count(*) OVER (PARTITION BY lang, quality) AS n FROM x),
     r AS (SELECT *, least(1.0, 10 / n) AS p FROM f WHERE k <= 10)
SELECT lang, count(*) AS drawn, round(sum(1 / p), 6) AS stands_for, round(sum(CAST(CAST(n_chars > 300 AS INT) = quality AS INT) / p) / sum(1 / p), 6) AS accuracy FROM r GROUP BY 1"""


# ---------------------------------------------------------------- streams


def st03(s, d):
    """Last writers over a stream of first touches, which come as files."""
    path = f"{shared_dir(s)}/touches-{uuid.uuid4().hex}"
    touches, _ = an._touches(s, d)
    touches.select("key", "who", F.unix_micros(F.col("t").cast("timestamp")).alias("t")).write.parquet(path)
    stream = s.readStream.schema("key long, who long, t long").parquet(path)
    return live.run_to_files(live.stream_last_writers(stream, "key", "who", "t"), f"writers_{uuid.uuid4().hex}")


QUERIES = {
    "EX-08_newton": (ex08, None),
    "EX-09_sharing": (ex09, None),
    "EX-14_penalties": (ex14, None),
    "EX-16_arms": (ex16, None),
    "EX-17_truths": (ex17, None),
    "EX-21_blocks": (ex21, None),
    "EX-22_accepted": (ex22, None),
    "SV-07_line_changes": (sv07, None),
    "SV-11_wald": (sv11, SV11),
    "SV-14_scopes": (sv14, SV14),
    "TR-05_features": (tr05, TR05),
    "TR-21_inheritance": (tr21, TR21),
    "TR-26_made_forests": (tr26, None),
    "TR-27_quotes": (tr27, TR27),
    "CP-03_bandwidth": (cp03, CP03),
    "CP-06_driver": (cp06, None),
    "CP-16_documented": (cp16, CP16),
    "SIM-04_generated": (sim04, None),
    "SIM-05_checks": (sim05, "SELECT * FROM (VALUES ('no_faster_than_chain', 150::BIGINT, 150::BIGINT), ('no_faster_than_team', 150, 150), ('no_slower_than_one', 150, 150), ('one_is_the_sum', 50, 50), ('many_are_the_chain', 50, 50)) t(\"check\", n, passed)"),
    "VA-03_flag_effect": (va03, VA03),
    "VA-09_agreement": (va09, VA09),
    "VA-10_adjudication": (va10, VA10),
    "ST-03_stream_writers": (st03, an.EDGES + "\nSELECT who, parent, key FROM e"),
}
