"""Versions of texts and the survival of what they hold: relations, presence spells, risk sets, hazards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from eventloom.operators import graph
from eventloom.shared import materialize


#: Rows back that are compared for equality (one back is ident), and that are searched for a beginning.
REVERT_WINDOW, FORK_WINDOW = 6, 50


def relations(df: DataFrame, by: str, order: str, text: str, revert: int = REVERT_WINDOW, fork: int = FORK_WINDOW) -> DataFrame:
    """(by, id, idx, prev, rel, base, base_lag): what each version of a text is to those before it; ids are the order, and unique.

    first; ident, equal to the one before; append, that is a beginning of this; revert, equal to one of a few rows
    back; trunc, a beginning of the one before; fork, one of some rows back (not empty) is a beginning of this;
    rewrite. base is the row that it goes back to, the latest of several. Whole texts are compared, by their length and
    a hash of 128 bits; texts themselves stay where they are, and the window holds a short row for each version.
    """
    w = W.partitionBy("by").orderBy("id")
    t = F.coalesce(F.col(text), F.lit(""))
    v = df.select(F.col(by).alias("by"), F.col(order).alias("id"), t.alias("text"), F.length(t).alias("len"), F.md5(t).alias("hash"))
    key = F.struct("id", "len", "hash")
    v = v.withColumn("idx", F.row_number().over(w)).withColumn("last", F.lag(key).over(w)).withColumn("back", F.collect_list(key).over(w.rowsBetween(-fork, -2)))
    # A beginning of this text, if it is not longer.
    begins = lambda x: (x["len"] < F.col("len")) & (F.md5(F.substring(F.col("text"), F.lit(1), x["len"])) == x["hash"])
    near = F.slice("back", F.greatest(F.lit(1), F.size("back") - (revert - 2)), F.lit(revert - 1))
    undone = F.filter(near, lambda x: (x["len"] == F.col("len")) & (x["hash"] == F.col("hash")))
    forked = F.filter("back", lambda x: (x["len"] > 0) & begins(x))
    # The one before, cut to this one's length, needs its text: it comes by its id.
    before = df.select(F.col(order).alias("was_id"), F.coalesce(F.col(text), F.lit("")).alias("was"))
    v = v.join(before, F.col("last.id") == F.col("was_id"), "left")
    cut = (F.col("len") < F.col("last.len")) & (F.md5(F.substring(F.col("was"), F.lit(1), F.col("len"))) == F.col("hash"))
    latest = lambda a: F.element_at(a, -1)["id"]
    one = lambda name, base: F.struct(F.lit(name).alias("rel"), base.cast(v.schema["id"].dataType).alias("base"))
    rel = (
        F.when(F.col("last").isNull(), one("first", F.lit(None)))
        .when((F.col("last.len") == F.col("len")) & (F.col("last.hash") == F.col("hash")), one("ident", F.col("last.id")))
        .when(begins(F.col("last")), one("append", F.col("last.id")))
        .when(F.size(undone) > 0, one("revert", latest(undone)))
        .when(cut, one("trunc", F.col("last.id")))
        .when(F.size(forked) > 0, one("fork", latest(forked)))
        .otherwise(one("rewrite", F.col("last.id")))
    )
    got = v.select("by", "id", "idx", F.col("last.id").alias("prev"), rel.alias("r")).select("by", "id", "idx", "prev", "r.rel", "r.base")
    places = got.select(F.col("id").alias("base"), F.col("idx").alias("base_idx"))
    return got.join(places, "base", "left").select("by", "id", "idx", "prev", "rel", "base", (F.col("idx") - F.col("base_idx")).alias("base_lag"))


GENERATIONS = ("first", "rewrite")


def lineage(rel: DataFrame) -> DataFrame:
    """rel with gen (the row that began its generation), depth, and of rows that begin one parent (generation) and input (row).

    rel is relations' table, already written: it is read several times. Chains are followed by pointer jumping. Joins
    are by exchange: a row for each version would be too much to send to the driver, however small its file.
    """
    begins = F.col("rel").isin(*GENERATIONS)
    gens = graph.forest(rel.select("id", F.when(~begins, F.col("base")).alias("up")), "id", "up").select(F.col("node").alias("id"), F.col("root").alias("gen"))
    # Of rows equal to the one before, the first of the run.
    same = graph.forest(rel.select("id", F.when(F.col("rel") == "ident", F.col("base")).alias("up")), "id", "up").select(F.col("node").alias("prev"), F.col("root").alias("input"))
    tops = rel.where(begins).select("id", F.when(F.col("rel") == "rewrite", F.col("prev")).alias("prev")).join(same.hint("merge"), "prev", "left").select("id", "input")
    tops = materialize(tops.join(gens.select(F.col("id").alias("input"), F.col("gen").alias("parent")).hint("merge"), "input", "left").select("id", "input", "parent"), "generations")
    depth = graph.forest(tops, "id", "parent").select(F.col("node").alias("gen"), F.col("generation").alias("depth"))
    return rel.join(gens.hint("merge"), "id").join(depth.hint("merge"), "gen").join(tops.hint("merge"), "id", "left")


def live_rows(rows: DataFrame) -> DataFrame:
    """Of lineage's table, rows that are not ident and whose generation a later row of the same text still descends from."""
    last = rows.groupBy("by").agg(F.max(F.struct("idx", "gen")).alias("m")).select(F.col("m.gen").alias("node"))
    tops = rows.where(F.col("rel").isin(*GENERATIONS)).select("id", "parent")
    live = graph.ancestors(tops, "id", "parent", last)
    return rows.where("rel <> 'ident'").join(live.withColumnRenamed("node", "gen").hint("merge"), "gen", "left_semi")


def presence_spells(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Runs of successive indices in which something is present: (by, spell, start, end)."""
    w = W.partitionBy(*by).orderBy(index)
    d = df.select(*by, index).distinct().withColumn("_i", F.col(index) - F.row_number().over(w))
    runs = d.groupBy(*by, "_i").agg(F.min(index).alias("start"), F.max(index).alias("end"))
    return runs.select(*by, F.row_number().over(W.partitionBy(*by).orderBy("start")).alias("spell"), "start", "end")


def risk_counts(df: DataFrame, by: list[str], last: str, lost: str) -> DataFrame:
    """(by, g, at_risk, lost): units tried at 1 to `last`; those lost are at their last trial.

    A unit adds one where its trials begin and takes one away where they end: two rows for a unit, whatever its length.
    """
    step = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("g"), F.lit(1).alias("dn"), F.lit(0).alias("d")), F.struct((F.col(last) + 1).cast("long").alias("g"), F.lit(-1).alias("dn"), F.lit(0).alias("d")), F.struct(F.col(last).cast("long").alias("g"), F.lit(0).alias("dn"), F.col(lost).cast("int").alias("d"))))
    n = df.select(*by, step.alias("x")).select(*by, "x.*").groupBy(*by, "g").agg(F.sum("dn").alias("dn"), F.sum("d").alias("lost"))
    run = F.sum("dn").over(W.partitionBy(*by).orderBy("g").rowsBetween(W.unboundedPreceding, 0))
    return n.withColumn("at_risk", run).where("at_risk > 0").select(*by, "g", "at_risk", "lost")


def hazards(risk: DataFrame, by: list[str]) -> DataFrame:
    """risk with hazard and the Kaplan-Meier survival, which is 0 from a hazard of 1 on."""
    w = W.partitionBy(*by).orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    h = risk.withColumn("hazard", F.col("lost") / F.col("at_risk"))
    dead = F.max((F.col("hazard") >= 1).cast("int")).over(w)
    return h.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("hazard") < 1, 1 - F.col("hazard")).otherwise(1.0))).over(w))))
