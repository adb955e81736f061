"""Tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode, as in tests, a new temporary one where it is unset; on a
    cluster that raises, for executors would write to their own discs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='eventloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder, which outlives executors, and read it back; by: a folder for each value of these columns.

    The files go when the application ends, or with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    got = spark.read.schema(df.schema).parquet(path)
    got._written_at = path
    return got


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() gave, once nothing will read it again."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def signature(df: DataFrame) -> str:
    """What tells a table from another: its columns, and the number of its rows with two sums of their hashes; the order of rows does not count."""
    h = F.xxhash64(*(F.col(c) for c in df.columns))
    half = F.lit((1 << 32) - 1)
    n, low, high = df.agg(F.count("*"), F.sum(h.bitwiseAND(half)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return hashlib.sha256(repr((df.dtypes, n, low, high)).encode()).hexdigest()[:32]


def cached(tag: str, version: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(table, whether it was there): make()'s table, kept in the shared folder under its version and its inputs' signatures.

    A table counts as there once its last file has been committed; a run that died in between is made again.
    """
    spark = inputs[0].sparkSession
    key = hashlib.sha256(repr((tag, version, [signature(i) for i in inputs])).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/cache/{tag}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def parts_for(rows: int, each: int = 1 << 18) -> int:
    """Into how many parts so many rows are dealt for a task to hold `each`, whatever they weigh when compressed."""
    return max(1, -(-rows // each))
