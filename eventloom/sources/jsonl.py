"""JSON lines to typed tables: a declared schema, tolerant casts, texts apart, and counters of what did not fit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CASTS = {"int", "bigint", "smallint", "tinyint", "double", "boolean"}


@dataclass(frozen=True)
class TableSpec:
    """columns: name -> type; text_columns go to a table of their own, by id; derive: name -> expression over `raw`."""

    name: str
    columns: dict[str, str]
    text_columns: tuple[str, ...] = ()
    derive: dict[str, str] = field(default_factory=dict)
    key: str = "id"


def _value(name: str, kind: str) -> Column:
    raw = F.get_json_object("raw", f"$.{name}")
    if kind in _CASTS:
        return F.expr(f"try_cast(get_json_object(raw, '$.{name}') AS {kind})")
    if kind == "timestamp":
        return F.expr(f"try_to_timestamp(substring(replace(rtrim('Z', get_json_object(raw, '$.{name}')), 'T', ' '), 1, 26))")
    return raw


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, gzip or not. A gzip file is one task to read; what follows is dealt out anew."""
    return spark.read.text(path).withColumnRenamed("value", "raw").where(F.trim("raw") != "")


def typed(lines: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(main, text) tables of the lines that are JSON objects. Values that do not fit their type are null."""
    good = lines.where(F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{"))
    values = {n: _value(n, k) for n, k in spec.columns.items()} | {n: F.expr(e) for n, e in spec.derive.items()}
    main = good.select(*(v.alias(n) for n, v in values.items() if n not in spec.text_columns))
    text = good.select(F.get_json_object("raw", f"$.{spec.key}").alias(spec.key), *(F.get_json_object("raw", f"$.{n}").alias(n) for n in spec.text_columns))
    return main, text


def counters(lines: DataFrame, spec: TableSpec) -> DataFrame:
    """Lines, lines that are no JSON objects, times that did not parse, and lines with keys that the spec does not know."""
    keys = F.json_object_keys("raw")
    known = F.array(*(F.lit(c) for c in [*spec.columns, *spec.text_columns]))
    bad = F.try_parse_json("raw").isNull() | ~F.ltrim("raw").startswith("{")
    lost = [F.count_if(F.get_json_object("raw", f"$.{n}").isNotNull() & _value(n, k).isNull()).alias(f"bad_{n}") for n, k in spec.columns.items() if k == "timestamp"]
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_bad"), F.count_if(F.size(F.array_except(keys, known)) > 0).alias("n_unknown"), *lost)


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Parquet with zstd; rows in order within files."""
    (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").parquet(path)
