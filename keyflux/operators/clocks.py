"""Replay of operation logs under asynchronous (asp), bulk-synchronous (bsp) and stale-synchronous (ssp) visibility.

A log has (seq, tid, flag, key, val), flags Add, Get and Clock, in the order of
arrival at one server.  With c(t) the Clocks of worker t so far, a row's mn is
the least c and its ck the issuing worker's own:

asp  a Get sees the last Add of its key before it.
bsp  Adds become visible when mn next rises; a Get is answered at version
     max(mn, ck) and sees the Adds with mn + 1 <= version.
ssp  a Get is answered at once if ck <= mn + staleness, else when mn first is
     ck - staleness, and sees the Adds before that.

Gets whose condition never comes stay unanswered.  Missing keys read as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .ordered import RANGE, last_before, running_sums


def workers(log: DataFrame) -> list[int]:
    """The workers of a log, a number each."""
    return [r["tid"] for r in log.select("tid").distinct().orderBy("tid").collect()]


#: Up to so many workers' clocks are columns of a row; those of more are counted by worker and joined.
COLUMNS = 64


def clocked(log: DataFrame, tids: list[int] | None = None, width: int = RANGE) -> DataFrame:
    """log with mn, ck and prev (mn before this row), written once: what follows reads it several times."""
    tids = workers(log) if tids is None else tids
    return saved((_by_columns if len(tids) <= COLUMNS else _by_rounds)(log, tids, width), "clocked")


def _by_columns(log: DataFrame, tids: list[int], width: int) -> DataFrame:
    tick = F.col("flag") == "Clock"
    d = running_sums(log, "seq", {f"c{i}": F.when(tick & (F.col("tid") == t), 1).otherwise(0).cast("long") for i, t in enumerate(tids)}, width=width)
    cs = [F.col(f"c{i}") for i in range(len(tids))]
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    own = F.coalesce(*[F.when(F.col("tid") == t, c) for t, c in zip(tids, cs)])
    was = [c - F.when(tick & (F.col("tid") == t), 1).otherwise(0) for t, c in zip(tids, cs)]
    return d.withColumns({"mn": least(cs), "ck": own, "prev": least(was)}).drop(*[f"c{i}" for i in range(len(tids))])


def _by_rounds(log: DataFrame, tids: list[int], width: int) -> DataFrame:
    """The least clock is the number of barriers that all workers have reached: it rises where the last one arrives."""
    named = log.sparkSession.createDataFrame([(t,) for t in tids], "tid long")
    mine = running_sums(log.join(F.broadcast(named), "tid", "left_semi"), "seq", {"ck": (F.col("flag") == "Clock").cast("long")}, by=("tid",), width=width)
    rises = barrier_rounds(log, tids, width).select("seq", F.lit(1).cast("long").alias("_rise"))
    d = log.join(mine.select("seq", "ck"), "seq", "left").join(rises, "seq", "left").withColumn("_rise", F.coalesce("_rise", F.lit(0).cast("long")))
    d = running_sums(d, "seq", {"mn": F.col("_rise")}, width=width)
    return d.withColumn("prev", F.col("mn") - F.col("_rise")).drop("_rise")


def progress(log: DataFrame) -> DataFrame:
    """(tid, clock) at the end."""
    return log.groupBy("tid").agg(F.count_if(F.col("flag") == "Clock").alias("clock"))


def min_clock_trace(log: DataFrame, tids: list[int] | None = None) -> DataFrame:
    """(seq, tid, ck, mn, changed_min) of the Clocks; changed_min is the new least clock if it moved, else -1."""
    c = clocked(log, tids).filter("flag = 'Clock'")
    return c.select("seq", "tid", "ck", "mn", F.when(F.col("mn") > F.col("prev"), F.col("mn")).otherwise(-1).alias("changed_min"))


def _answers(rows: DataFrame, at: str, order: list[str], width: int) -> DataFrame:
    found = last_before(rows, "key", at, order, F.when(F.col("flag") == "Add", F.col("val")), width)
    return found.filter("flag = 'Get'").select("seq", "tid", "key", F.coalesce("_last", F.lit(0.0)).alias("val"))


def asp_get(log: DataFrame, width: int = RANGE) -> DataFrame:
    """(seq, tid, key, val) of every Get."""
    return _answers(log.filter("flag <> 'Clock'"), "seq", [], width)


def bsp_get(log: DataFrame, tids: list[int] | None = None, width: int = RANGE) -> DataFrame:
    """(seq, tid, key, val) of the answered Gets."""
    c = clocked(log, tids, width)
    top = c.agg(F.max("mn").alias("top"))
    rows = c.filter("flag <> 'Clock'").join(F.broadcast(top))
    rows = rows.withColumn("version", F.when(F.col("flag") == "Add", F.col("mn") + 1).otherwise(F.greatest("mn", "ck")))
    rows = rows.filter("flag = 'Add' or ck <= top").withColumn("late", (F.col("flag") == "Get").cast("int"))
    return _answers(rows, "version", ["late", "seq"], max(1, width >> 8))


def ssp_get(log: DataFrame, staleness: int, tids: list[int] | None = None, width: int = RANGE) -> DataFrame:
    """(seq, tid, key, val) of the answered Gets."""
    c = clocked(log, tids, width)
    first = c.groupBy("mn").agg(F.min("seq").alias("reached")).select(F.col("mn").alias("_due"), "reached")
    waits = (F.col("flag") == "Get") & (F.col("ck") > F.col("mn") + staleness)
    rows = c.filter("flag <> 'Clock'").withColumn("_due", F.when(waits, F.col("ck") - staleness)).join(first, "_due", "left")
    rows = rows.filter(~waits | F.col("reached").isNotNull()).withColumn("release", F.when(waits, F.col("reached")).otherwise(F.col("seq")))
    return _answers(rows, "release", ["seq"], width)


def bsp_pending_adds(log: DataFrame, tids: list[int] | None = None, width: int = RANGE) -> DataFrame:
    """(seq, pending) after each Clock: Adds since the least clock last moved."""
    c = running_sums(clocked(log, tids, width), "seq", {"adds": (F.col("flag") == "Add").cast("long")}, width=width)
    base = c.filter("mn > prev").select("mn", F.col("adds").alias("applied"))
    out = c.filter("flag = 'Clock'").join(base, "mn", "left")
    return out.select("seq", (F.col("adds") - F.coalesce("applied", F.lit(0))).alias("pending"))


def bsp_pending_gets(log: DataFrame, tids: list[int] | None = None) -> DataFrame:
    """(pending): Gets that are unanswered at the log's end."""
    c = clocked(log, tids)
    return c.filter("flag = 'Get'").join(F.broadcast(c.agg(F.max("mn").alias("top")))).agg(F.count_if(F.col("ck") > F.col("top")).alias("pending"))


def ssp_blocked(log: DataFrame, staleness: int, tids: list[int] | None = None) -> DataFrame:
    """(seq, blocked, release_clock) of every Get; release_clock is ck - staleness, -1 where it isn't blocked."""
    c = clocked(log, tids).filter("flag = 'Get'")
    waits = F.col("ck") > F.col("mn") + staleness
    return c.select("seq", waits.cast("int").alias("blocked"), F.when(waits, F.col("ck") - staleness).otherwise(-1).alias("release_clock"))


def ssp_pending(log: DataFrame, staleness: int, tids: list[int] | None = None) -> DataFrame:
    """(release_clock, pending): blocked Gets by the clock that releases them."""
    return ssp_blocked(log, staleness, tids).filter("blocked = 1").groupBy("release_clock").agg(F.count("*").alias("pending"))


def dispatch(log: DataFrame, models: list[int]) -> DataFrame:
    """(model_id, flag, n): what servers of these models handle; rows of other models and unknown flags are skipped."""
    known = F.col("flag").isin("Add", "Get", "Clock", "Reset")
    return log.filter(known & F.col("model_id").isin(models)).groupBy("model_id", "flag").agg(F.count("*").alias("n"))


def barrier_rounds(log: DataFrame, tids: list[int], width: int = RANGE) -> DataFrame:
    """(round, seq): when the last worker reaches each barrier, a Clock being an arrival."""
    named = log.sparkSession.createDataFrame([(t,) for t in tids], "tid long")
    clocks = log.filter(F.col("flag") == "Clock").join(F.broadcast(named), "tid", "left_semi").select("tid", "seq")
    arrivals = running_sums(clocks, "seq", {"round": F.lit(1)}, by=("tid",), width=width)
    return arrivals.groupBy(F.col("round").cast("int").alias("round")).agg(F.max("seq").alias("seq"), F.count("*").alias("n")).filter(F.col("n") == len(tids)).select("round", "seq")
