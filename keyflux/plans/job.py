"""Jobs: supersteps over mini-batches driven from the driver, and a function per worker over its rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kv, models, schedule
from ..session import discard, saved
from .params import Params

log = logging.getLogger("keyflux")


# --- worker functions ----------------------------------------------------------


class Client:
    """A worker's view of one table: what it held when the task began, and the worker's own writes, which take effect when the task ends."""

    def __init__(self, number: int, keys: np.ndarray, vals: np.ndarray, writes: list):
        self.number, self._keys, self._vals, self._writes = number, keys, vals, writes

    def get(self, keys: list[int]) -> list[float]:
        """Values of the distinct keys, by key; 0 where there is none."""
        wanted = np.unique(np.asarray(keys, np.int64))
        if not len(self._keys):
            return [0.0] * len(wanted)
        at = np.minimum(np.searchsorted(self._keys, wanted), len(self._keys) - 1)
        return np.where(self._keys[at] == wanted, self._vals[at], 0.0).tolist()

    def add(self, keys: list[int], vals: list[float]) -> None:
        self._writes += [(self.number, k, v) for k, v in kv.checked(keys, vals)]


@dataclass
class Info:
    """What a worker's function is given beside its rows."""

    worker_id: int
    thread_id: int
    tables: dict[int, Client]
    workload: int
    times: list[float] = field(default_factory=list)

    def report_time(self, value: float) -> None:
        self.times.append(value)


@dataclass
class Task:
    """A job: a function of (Info, iterator of pandas frames) per worker, the allocation of workers, and the tables it uses.

    The function yields result frames.  Tables are numbers of a kv.Store; each
    is sent to the workers as it is at the start, kv.BROADCAST_ROWS rows of it
    at most.  scheduler, if given, maps the workers' reported times
    (iter, tid, time, old_w) to new workloads, as schedule.rebalance does.
    """

    function: Callable | None = None
    allocation: DataFrame | None = None
    tables: list[int] = field(default_factory=list)
    scheduler: Callable[[DataFrame], DataFrame] | None = None
    workloads: dict[int, int] = field(default_factory=dict)

    def is_set_up(self) -> bool:
        return self.function is not None and self.allocation is not None and bool(self.tables)

    def run(self, rows: DataFrame, schema: str, store: kv.Store | None = None, workload: int = 100) -> DataFrame:
        """The function's results; rows have worker_id.

        A worker's rows reach its function as a stream of Arrow batches: one
        worker is one task, but none of its rows need be held.  Writes go to the
        store, the last of a worker (then of the largest worker) winning, and
        its workers' clocks advance; reported times go to the scheduler.
        """
        if not self.is_set_up():
            raise ValueError("a task needs a function, an allocation and tables")
        spark, function, loads = rows.sparkSession, self.function, dict(self.workloads)
        state = {}
        for number in self.tables:
            found = store.state(number) if store else None
            if found is not None and found.count() > kv.BROADCAST_ROWS:
                raise ValueError(f"table {number} has more than {kv.BROADCAST_ROWS} rows; join with it instead")
            pdf = found.toPandas().sort_values("key") if found is not None else pd.DataFrame({"key": np.empty(0, np.int64), "val": np.empty(0)})
            state[number] = (pdf["key"].to_numpy(np.int64), pdf["val"].to_numpy(float))
        packed = spark.sparkContext.broadcast(state)
        result = T._parse_datatype_string(schema)
        extra = ["_table", "_seq", "_key", "_val", "_worker", "_tid", "_time"]
        types = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType()]
        full = T.StructType([T.StructField(f.name, f.dataType) for f in result.fields] + [T.StructField(n, t) for n, t in zip(extra, types)])
        names = [f.name for f in full.fields]

        def framed(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.reindex(columns=names)

        def work(frames: Iterator[pd.DataFrame]):
            stream = ((int(w), int(part["tid"].iloc[0]), part.drop(columns=["tid"])) for f in frames for w, part in f.groupby("worker_id", sort=False))
            now = next(stream, None)
            while now is not None:
                worker, tid, writes, at = now[0], now[1], [], [now]

                def mine(worker=worker, at=at):
                    while at[0] is not None and at[0][0] == worker:
                        yield at[0][2]
                        at[0] = next(stream, None)

                info = Info(worker, tid, {n: Client(n, k, v, writes) for n, (k, v) in packed.value.items()}, loads.get(tid, workload))
                rest = mine()
                for out in function(info, rest):
                    yield framed(out.assign(_worker=worker, _tid=tid))
                for _ in rest:  # rows that the function did not read
                    pass
                if writes:
                    n, k, v = zip(*writes)
                    yield framed(pd.DataFrame({"_table": n, "_seq": range(len(n)), "_key": k, "_val": v, "_worker": worker, "_tid": tid}))
                if info.times:
                    yield framed(pd.DataFrame({"_time": info.times, "_worker": worker, "_tid": tid}))
                now = at[0]

        # by a hash of its own: an exchange by the join's key is planned away, and adaptive execution then splits a worker's rows over tasks
        dealt = rows.join(self.allocation.select("worker_id", "tid"), "worker_id").repartition(F.xxhash64("worker_id")).sortWithinPartitions("worker_id")
        done = saved(dealt.mapInPandas(work, full), "task")
        if store:
            for number in self.tables:
                w = done.filter(F.col("_table") == number).select(F.struct("_worker", "_seq").alias("seq"), F.col("_key").alias("key"), F.col("_val").alias("val"))
                store.add_ordered(number, w)
        times = done.filter("_time is not null").groupBy("_tid").agg(F.sum("_time").alias("time"))
        if self.scheduler:
            workers = [r["tid"] for r in self.allocation.select("tid").collect()]  # a row a worker
            now_ = times.sparkSession.createDataFrame([(0, t, loads.get(t, workload)) for t in workers], "iter int, tid long, old_w int").join(times.withColumnRenamed("_tid", "tid"), "tid")
            self.workloads = {r["tid"]: r["new_w"] for r in self.scheduler(now_.select("iter", "tid", "time", "old_w")).collect()}
        return done.filter("_table is null and _time is null").select(*result.fieldNames())


# --- training --------------------------------------------------------------------


@dataclass
class Trained:
    """What a training loop ends with: the state, the test samples, and a row (iter, worker, workload, time) per worker and superstep."""

    state: tuple[DataFrame, ...]
    test: DataFrame
    report: list[tuple[int, int, int, float]]


def train(step: Callable[[DataFrame, tuple], tuple], samples: DataFrame, state: tuple, p: Params, order: str = "sample_id", scheduler: Callable[[DataFrame], DataFrame] = schedule.rebalance, speeds: dict[int, float] | None = None, seed: int = 0) -> Trained:
    """p.n_iters supersteps of step(batch, state) -> state over the samples' workers (column worker).

    Each worker's last p.test_rows samples are the test set, and not trained on
    with p.holdout.  In every superstep a worker takes its workload of samples
    (p.batch_size, to begin with) in an order drawn anew, coming round again if
    it has fewer.  With p.scheduler the workloads follow the workers' times:
    workload * speed (1 unless given), with the delays that p injects; they are
    rebalanced and read anew at p.refresh_rate, as the original's scheduler and
    workers do.  The state is written after every superstep.  Only workers'
    workloads and times pass through the driver.
    """
    spark = samples.sparkSession
    training, test = models.hold_out_last(samples, p.test_rows, order, p.holdout, "worker")
    training, test = saved(training, "training"), saved(test, "test")
    counts = saved(training.groupBy("worker").agg(F.count("*").alias("_n")), "counts")
    workers = sorted(r["worker"] for r in counts.collect())
    published = {w: p.batch_size for w in workers}
    loads, report = dict(published), []
    for i in range(p.n_iters):
        if p.scheduler and schedule.refreshes(i, p.refresh_rate):
            loads = dict(published)
        size = spark.createDataFrame(list(loads.items()), "worker long, size int") if len(set(loads.values())) > 1 else p.batch_size if not loads else next(iter(loads.values()))
        batch = models.batch(training, size, "worker", order, models.shuffled(order, seed, i), counts)
        new = tuple(saved(x, f"state-{i}") for x in step(batch, state))
        for old, now in zip(state, new):
            discard(old)
        state = new
        if workers:
            rows = [(i, w, float(loads[w] * (speeds or {}).get(w, 1.0)), published[w]) for w in workers]
            times = spark.createDataFrame(rows, "iter int, worker_id long, time double, old_w int")
            if p.transient or p.permanent or p.straggler_probability:
                times = schedule.injected_delay(times, p.straggler_percent, p.straggler_probability, p.transient, p.permanent, seed + i)
            times = times.withColumnRenamed("worker_id", "tid")
            acts = p.scheduler and schedule.due(i, p.refresh_rate)
            done = (scheduler(times) if acts else times.withColumn("new_w", F.col("old_w"))).collect()
            report += [(i, r["tid"], loads[r["tid"]], r["time"]) for r in sorted(done, key=lambda r: r["tid"])]
            published = {r["tid"]: r["new_w"] for r in done}
        if i % max(1, p.n_iters // 10) == 0:
            log.info("superstep %d of %d: %d samples", i, p.n_iters, sum(loads.values()))
    return Trained(state, test, report)


def _top(weights: DataFrame, samples: DataFrame, p: Params) -> int:
    """A number that all keys are below: n_features + 1 if that is set, else found in the data."""
    if p.n_features >= 0:
        return p.n_features + 1
    of_samples = samples.agg(F.max(F.array_max(F.transform("features", lambda f: f["idx"].cast("long"))))).first()[0]
    return max(of_samples or 0, weights.agg(F.max("key")).first()[0] or 0) + 1


def train_lr(samples: DataFrame, weights: DataFrame, p: Params, compat: bool = True, **options) -> Trained:
    rows = _top(weights, samples, p)
    return train(lambda b, s: (models.lr_step(b, s[0], p.alpha, compat, rows, p.prefetch),), samples, (weights,), p, **options)


def train_svm(samples: DataFrame, weights: DataFrame, p: Params, **options) -> Trained:
    rows = _top(weights, samples, p)
    return train(lambda b, s: (models.svm_step(b, s[0], p.learning_rate, p.lam, rows),), samples, (weights,), p, **options)


def train_mf(ratings: DataFrame, users: DataFrame, items: DataFrame, mean: float, p: Params, **options) -> Trained:
    """ratings (pos, worker, user, item, rating); of a superstep's pushes the one with the larger (b, worker) wins."""

    def step(batch: DataFrame, state: tuple) -> tuple:
        return models.mf_step(batch.withColumn("pos", F.struct("b", "worker")), *state, mean, p.rank, p.alpha, p.beta)

    return train(step, ratings, (users, items), p, "pos", **options)


def workers_of(samples: DataFrame, p: Params, nodes: int = 1, order: str = "sample_id") -> DataFrame:
    """samples dealt to p.n_workers_per_node workers on each node."""
    return samples.withColumn("worker", F.pmod(order, F.lit(nodes * p.n_workers_per_node)).cast("long"))


def swept(samples: DataFrame, weights: DataFrame, jobs: list[Params], nodes: int = 1) -> list[tuple[Params, Trained]]:
    """Logistic regression trained once per job, each with its own batches, workers and supersteps."""
    return [(p, train_lr(workers_of(samples, p, nodes), weights, p)) for p in jobs]


def simulate(spark: SparkSession, speeds: dict[int, float], iterations: int, batch_size: int = 100, rate: int = 5, injected: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(iter, tid, time, workload): workers whose time is workload * speed, rebalanced when the scheduler is due.

    Only the few workers' times and workloads pass through the loop.
    """
    loads = {t: batch_size for t in speeds}
    rows = []
    for i in range(iterations):
        now = spark.createDataFrame([(i, t, float(loads[t] * speeds[t]), loads[t]) for t in speeds], "iter int, tid long, time double, old_w int")
        if injected:
            now = injected(now.withColumnRenamed("tid", "worker_id")).withColumnRenamed("worker_id", "tid").select("iter", "tid", "time", "old_w")
        done = (schedule.rebalance(now) if schedule.due(i, rate) else now.withColumn("new_w", F.col("old_w"))).collect()
        rows += [(i, r["tid"], r["time"], r["old_w"]) for r in done]
        loads = {r["tid"]: r["new_w"] for r in done}
    return spark.createDataFrame(rows, "iter int, tid long, time double, workload int")


