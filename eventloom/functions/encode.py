"""Columns for a report's tables: types, dictionaries of repeated values, and JSON that every reader takes."""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_type(values: list) -> str:
    """boolean, integer, number, date, time or text: the narrowest that holds all values but nulls; empty without any."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return "empty"
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "integer"
    if kinds <= {int, float}:
        return "number"
    if kinds == {dt.date}:
        return "date"
    if kinds <= {dt.datetime, dt.date}:
        return "time"
    return "text"


def safe(v):
    """A value in JSON's types: not-a-number and infinities are null, times are ISO text, whole numbers beyond 2**53 text."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) > 1 << 53:
        return str(v)
    if isinstance(v, (list, tuple)):
        return [safe(x) for x in v]
    if isinstance(v, dict):
        return {str(k): safe(x) for k, x in v.items()}
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def encode_column(name: str, values: list) -> dict:
    """A column as values, or as a dictionary with codes (-1 for null) where that is shorter in JSON."""
    plain = [safe(v) for v in values]
    out = {"name": name, "type": column_type(values), "values": plain}
    if out["type"] == "text":
        words = sorted({str(v) for v in plain if v is not None})
        place = {w: i for i, w in enumerate(words)}
        coded = {"name": name, "type": "text", "dictionary": words, "codes": [-1 if v is None else place[str(v)] for v in plain]}
        if len(dumps(coded)) < len(dumps(out)):
            return coded
    return out


def decode_column(c: dict) -> list:
    return [None if k < 0 else c["dictionary"][k] for k in c["codes"]] if "codes" in c else c["values"]


def dumps(x) -> str:
    """Compact JSON that may stand inside a script element."""
    return json.dumps(x, separators=(",", ":"), allow_nan=False, ensure_ascii=False).replace("</", "<\\/").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_null, n_values, coded) of a table of any size: what encode_column would choose, counted in one pass.

    coded: whether a dictionary and codes take fewer characters than the values.
    """
    names = {T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.DoubleType: "number", T.FloatType: "number", T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "time"}
    kinds = {f.name: names.get(type(f.dataType), "text") for f in df.schema.fields}
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("type"), F.col(c).cast("string").alias("v")) for c, k in kinds.items())))
    n = df.select(cells.alias("x")).groupBy("x.column", "x.type", "x.v").agg(F.count("*").alias("n"))
    w = F.length("v") + 3  # quotes and a comma
    g = n.groupBy("column", "type").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_values"), F.sum(F.when(F.col("v").isNotNull(), w * F.col("n"))).alias("plain"), F.sum(F.when(F.col("v").isNotNull(), w)).alias("words"), F.sum("n").alias("rows"))
    digits = F.length(F.col("n_values").cast("string")) + 1
    coded = (F.col("type") == "text") & (F.col("words") + digits * F.col("rows") < F.col("plain") + 5 * F.col("n_null"))
    return g.select("column", "type", "n_null", "n_values", F.coalesce(coded, F.lit(False)).alias("coded"))
