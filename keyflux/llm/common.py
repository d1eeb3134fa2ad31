"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, saved, shared_dir, table

__all__ = ["SPACE", "connected", "forget", "fresh_path", "materialize", "release", "runs", "shared_dir", "table"]
#: Characters that separate words, as a class for regular expressions.
SPACE = r"[\x20\x09-\x0D]"
_written: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/keyflux/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    out = saved(df, label)
    _written.append((df.sparkSession, out._keyflux_path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing will read again, and let the JVM see which shuffles nothing holds any more: Spark deletes their files then."""
    for t in tables:
        discard(t)
        _written[:] = [(s, p) for s, p in _written if p != t._keyflux_path]
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every table written by materialize() in this process; call it once the results are stored."""
    keep = []
    for owner, path in _written:
        try:
            _delete(owner, path)
        except Exception:  # noqa: BLE001 - the store may be gone already
            keep.append((owner, path))
    _written[:] = keep


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        release(spark)


if not os.environ.get("SPARK_EXECUTOR_ID"):
    atexit.register(_at_exit)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in their first `keys` columns, from batches sorted by them."""
    held: list[tuple] = []
    now: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = row[:keys]
            if key != now:
                if held:
                    yield now, held
                held, now = [], key
            held.append(row[keys:])
    if held:
        yield now, held


def connected(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest node of each node's component, as (node, root), for the nodes of edges (a, b).

    Alternating large-star and small-star steps until nothing changes; each step
    is one aggregation with map-side combining and one join that the adaptive
    planner may split, and is written to the shared folder.  Empty edges give an
    empty result; loops are ignored.
    """
    e = edges.select("a", "b").filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, label)
    last = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        large = materialize(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        e = materialize(small, label)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
