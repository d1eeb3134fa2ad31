"""Timing statistics over series of durations (whole microseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import first_rows


def summary(timings: DataFrame, by: str = "tid", value: str = "dur_us", throw_away: int = 0, order: str = "seq") -> DataFrame:
    """(by, n, total, mean, st_dev) in whole numbers: the mean cut off, the deviation around it, variance and root cut off.

    throw_away leaves out so many first measurements of each series.
    """
    t = timings
    if throw_away:
        gone = first_rows(t.select(by, order), throw_away, [by], [F.col(order)], [order]).drop("_rank")
        t = t.join(gone, [by, order], "left_anti")
    s = t.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(value).cast("decimal(38,0)") * F.col(value)).alias("_squares"))
    s = s.withColumn("mean", F.expr("total div n"))
    # sum((x - mean)^2) = sum(x^2) - 2 mean sum(x) + n mean^2, exactly
    var = "cast((_squares - 2 * cast(mean as decimal(20,0)) * total + cast(n as decimal(20,0)) * mean * mean) as decimal(38,0)) div n"
    return s.select(by, "n", "total", "mean", F.floor(F.sqrt(F.expr(var).cast("double"))).cast("long").alias("st_dev"))


def last_n(timings: DataFrame, ns: dict[str, int | None], by: str = "tid", value: str = "dur_us", order: str = "seq") -> DataFrame:
    """Sum of each series' last n durations, all for None; fewer where a series is shorter."""
    out = timings.groupBy(by).agg(*[F.sum(value).alias(k) for k, n in ns.items() if not n], F.lit(0).alias("_"))
    some = {k: n for k, n in ns.items() if n}
    if some:
        last = first_rows(timings.select(by, order, value), max(some.values()), [by], [F.col(order).desc()], [order])
        out = out.join(last.groupBy(by).agg(*[F.sum(F.when(F.col("_rank") < n, F.col(value))).alias(k) for k, n in some.items()]), by)
    return out.select(by, *ns)


def sum_by_iteration(timings: DataFrame, value: str = "dur_us") -> DataFrame:
    return timings.groupBy("iter").agg(F.sum(value).alias("total"))


def measure(function, *args, repeat: int = 1, warm_up: int = 0):
    """Run function; (last result, [microseconds] without the warm-up runs)."""
    import time

    times, result = [], None
    for i in range(repeat + warm_up):
        began = time.perf_counter_ns()
        result = function(*args)
        if i >= warm_up:
            times.append((time.perf_counter_ns() - began) // 1000)
    return result, times


class Timer:
    """Start, pause, resume and stop; `times` holds a duration per stop, in microseconds."""

    def __init__(self):
        self.times: list[int] = []
        self._sum, self._since = 0, None

    def start(self) -> None:
        self._sum = 0
        self.resume()

    def resume(self) -> None:
        import time

        self._since = time.perf_counter_ns()

    def pause(self) -> None:
        import time

        if self._since is not None:
            self._sum += time.perf_counter_ns() - self._since
            self._since = None

    def stop(self) -> int:
        self.pause()
        self.times.append(self._sum // 1000)
        return self.times[-1]

    def measure(self, function, *args):
        """Run function and record how long it took; its result."""
        self.start()
        out = function(*args)
        self.stop()
        return out

    def reset(self) -> None:
        self.times.clear()

    def last(self, n: int) -> int:
        return sum(self.times[-n:])

    def mean(self) -> int:
        return sum(self.times) // len(self.times)

    def st_dev(self) -> int:
        m = self.mean()
        return int((sum((t - m) ** 2 for t in self.times) // len(self.times)) ** 0.5)
