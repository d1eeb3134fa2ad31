"""Workloads moved from slow workers to fast ones, by their times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOW, GIVEN = 1.5, 0.2


def stragglers(times: DataFrame, by: str = "iter") -> DataFrame:
    """times (by, tid, time) with straggler: 1 where a worker took over SLOW times the fastest's time."""
    fastest = F.min("time").over(Window.partitionBy(by))
    return times.withColumn("straggler", (F.col("time") > SLOW * fastest).cast("int"))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def rebalance(times: DataFrame, by: str = "iter") -> DataFrame:
    """(by, tid, time, old_w) -> the same with new_w.

    A straggler gives up round(GIVEN * w) of its workload w.  The others take
    from what was given in order of their times (then their thread): each
    round(rest / takers left), while at least 1 is left.  The workers of one
    iteration, few, are folded as an array.
    """
    s = stragglers(times, by)
    given = _half_up(GIVEN * F.col("old_w"))
    fast = Window.partitionBy(by, "straggler").orderBy("time", "tid")
    everyone = Window.partitionBy(by)
    s = s.withColumn("pool", F.sum(F.when(F.col("straggler") == 1, given).otherwise(0)).over(everyone)).withColumn("takers", F.sum(1 - F.col("straggler")).over(everyone)).withColumn("place", F.row_number().over(fast))
    zero = F.struct(F.col("pool").cast("int").alias("rest"), F.lit(0).alias("took"))

    def take(acc: Column, i: Column) -> Column:
        share = F.when(acc["rest"] < 1, 0).otherwise(_half_up(acc["rest"] / (F.col("takers") - i + 1)))
        return F.struct((acc["rest"] - share).cast("int").alias("rest"), share.cast("int").alias("took"))

    took = F.aggregate(F.sequence(F.lit(1), F.col("place")), zero, take)["took"]
    kept = _half_up((1 - GIVEN) * F.col("old_w"))
    return s.select(by, "tid", "time", "old_w", F.when(F.col("straggler") == 1, kept).otherwise(F.col("old_w") + took).cast("int").alias("new_w"))


def injected_delay(times: DataFrame, percent: float = 100.0, probability: float = 0.0, transient: bool = False, permanent: bool = False, seed: int = 0) -> DataFrame:
    """times (iter, worker_id, time) with the delays a test run would add: at random, worker 1 in iterations 50 to 74, or worker 3 always."""
    hit = F.rand(seed) < probability
    if transient:
        hit = hit | ((F.col("worker_id") == 1) & F.col("iter").between(50, 74))
    if permanent:
        hit = hit | (F.col("worker_id") == 3)
    return times.withColumn("time", F.col("time") * (1 + F.when(hit, percent / 100.0).otherwise(0.0)))


def due(iteration: int, rate: int) -> bool:
    """Whether the scheduler acts."""
    return iteration % (rate + 1) == 0


def refreshes(iteration: int, rate: int) -> bool:
    """Whether workers read their workload anew."""
    return iteration % rate == 0
