"""Prefix computations over one total order, without moving all rows to one task.

Rows fall into ranges of the order; ranges are summarised, the summaries (one a
range) are accumulated, and each range is then finished on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order that make a range.
RANGE = 1 << 16


def running_sums(df: DataFrame, order: str, terms: dict[str, Column], by: tuple[str, ...] = (), width: int = RANGE) -> DataFrame:
    """df with, for each name, the sum of its term over the rows up to and including this one."""
    d = df.withColumn("_range", F.floor(F.col(order) / width))
    d = d.withColumns({f"_t_{k}": v for k, v in terms.items()})
    totals = d.groupBy(*by, "_range").agg(*[F.sum(f"_t_{k}").alias(f"_s_{k}") for k in terms])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in terms])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_i_{k}": F.sum(f"_t_{k}").over(inside) for k in terms}).join(base, [*by, "_range"])
    return d.select(*[c for c in df.columns], *[(F.col(f"_b_{k}") + F.col(f"_i_{k}")).alias(k) for k in terms])


def last_before(df: DataFrame, key: str, at: str, order: list[str], value: Column, width: int = RANGE) -> DataFrame:
    """df with `_last`: the last non-null value of the same key before this row, by (at, *order).

    A key with very many rows is dealt by ranges of `at`; the last value of
    each earlier range is carried over.
    """
    d = df.withColumn("_range", F.floor(F.col(at) / width)).withColumn("_v", value)
    place = F.struct(at, *order)
    ends = d.filter(F.col("_v").isNotNull()).groupBy(key, "_range").agg(F.max_by("_v", place).alias("_end"))
    # each range that a key has rows in, with the last end of its earlier ranges
    ranges = d.select(key, "_range").distinct().join(ends, [key, "_range"], "left")
    carry = ranges.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    inside = Window.partitionBy(key, "_range").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)).join(carry, [key, "_range"])
    return d.withColumn("_last", F.coalesce("_here", "_carry")).drop("_range", "_v", "_here", "_carry")


def first_rows(df: DataFrame, n: int, by: list[str], order: list[Column], salt: list[str], salts: int = 64) -> DataFrame:
    """The first n rows of each group by order, with `_rank` from 0.

    Groups are cut to n rows in salted parts first (by hash of the salt
    columns), then as a whole: one of any size is no task's alone.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(salts)))
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).filter(F.col("_rank") <= n).drop("_salt")
    return d.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).filter(F.col("_rank") < n)
