"""More queries: files written and read back, stores, worker tasks, training jobs, streams; each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import kv, models, slices
from .plans import job
from .plans.params import Params, sweep
from .queries import OPS, RATINGS, SAMPLES, START, STATE, TIMINGS, _jump_sql, _rounded, _stats, adds, op_log, query, ratings, samples, start_weights
from .session import shared_dir, table
from .sources import idx, text
from .streaming import oplog


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/keyflux/{label}-{uuid.uuid4().hex}"


# --- files -----------------------------------------------------------------------


def _rating_files(spark, sf) -> str:
    path = _path(spark, "ratings")
    ratings(spark, sf).select(F.concat_ws("\t", "user", "item", "rating").alias("value")).repartition(3).write.text(path)
    return path


@query(f"""WITH {RATINGS} SELECT "user", item, rating, count(*) AS n FROM r GROUP BY ALL""")
def files_ratings(spark, sf):
    """Text files scanned by blocks of a few kilobytes: no line is lost or read twice where blocks meet."""
    r = text.load(spark, _rating_files(spark, sf), text.parse_ratings, block_bytes=4096)
    return r.groupBy("user", "item", "rating").agg(F.count("*").alias("n"))


@query(f"""WITH {RATINGS} SELECT CAST(sum(strlen("user" || chr(9) || item || chr(9) || rating) + 1) AS BIGINT) AS bytes, count(*) AS n_lines FROM r""")
def files_listed(spark, sf):
    path = _rating_files(spark, sf)
    return text.list_files(spark, path).agg(F.sum("length").alias("bytes")).join(text.read_lines(spark, path).agg(F.count("*").alias("n_lines")))


@query(f"WITH {SAMPLES} SELECT y AS label, idx, count(*) AS n, round(sum(x), 4) AS total FROM s GROUP BY ALL")
def files_libsvm(spark, sf):
    path = _path(spark, "libsvm")
    s = samples(spark, sf).select("sample_id", F.col("y").alias("label"), F.map_from_entries("features").alias("features"))
    text.render_libsvm(s).select("value").write.text(path)
    loaded = text.long_samples(text.load(spark, path, text.parse_libsvm))
    return loaded.groupBy("label", "idx").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))


@query(f"""WITH {RATINGS} SELECT count(*) AS n, CAST(sum(rating) AS BIGINT) AS total FROM r""")
def files_prefetched(spark, sf):
    """Batches read ahead by a thread of each worker while the one before is added up."""

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(batch)], "total": [int(batch["rating"].sum())]})

    r = text.load(spark, _rating_files(spark, sf), text.parse_ratings)
    return text.map_batches(r, add, "n long, total long", size=1000).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(f"WITH {TIMINGS} SELECT CASE event_type WHEN 'click' THEN 'ITER' WHEN 'view' THEN 'WAIT' WHEN 'purchase' THEN 'PROC' WHEN 'signup' THEN 'TIME' ELSE 'TOTL' END AS stat_type, count(*) AS n, round(sum(CAST(dur_us AS DOUBLE)), 1) AS total FROM t WHERE event_type IN ('click', 'view', 'purchase', 'signup', 'error') GROUP BY 1")
def stats_csv(spark, sf):
    path = _path(spark, "stats")
    text.write_stats(_stats(spark, sf).filter("stat_type is not null"), path)
    back = spark.read.schema("iter int, tid long, value double, stat_type string").csv(path)
    return back.groupBy("stat_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("total"))


@query(f"WITH {TIMINGS} SELECT iter, CAST(sum(dur_us) AS BIGINT) AS total FROM t GROUP BY iter")
def iter_totals_text(spark, sf):
    path = _path(spark, "totals")
    e = table(spark, sf, "events")
    t = e.select(F.floor(F.col("event_id") / 100).cast("int").alias("iter"), F.round(F.col("value") * 1000).cast("long").alias("dur_us"))
    text.write_totals(t.groupBy("iter").agg(F.sum("dur_us").alias("total")), path)
    p = F.split("value", " ")
    return text.read_lines(spark, path).select(p[0].cast("int").alias("iter"), p[1].cast("long").alias("total"))


_PIXELS = "CAST(floor((CAST(x AS DOUBLE) + 1) * 100) AS INTEGER)"


@query(f"""WITH e AS (SELECT vec_id, CAST(label AS SMALLINT) AS label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, list_transform(embedding, lambda x: {_PIXELS}) AS p FROM embeddings),
r AS (SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY vec_id) - 1 AS INTEGER) AS idx, label, p FROM e)
SELECT split, idx, label, CAST(list_sum(p) AS BIGINT) AS total, CAST(list_sum(list_transform(p, lambda v: CASE WHEN v > 30 THEN 1 ELSE 0 END)) AS BIGINT) AS bright, CAST(p[1] AS BIGINT) AS first FROM r""")
def idx_dataset(spark, sf):
    """Four IDX files written from the vectors, read back as a data set; sums of pixels, plain and binarized."""
    path = _path(spark, "idx")
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("int")).alias("p"))
    for split, of in (("test", "vec_id % 5 = 0"), ("train", "vec_id % 5 <> 0")):
        part = e.filter(of).orderBy("vec_id")
        images, labels = idx.FILES[split]
        idx.write_images(part.select("p"), f"{path}/{images}", 8, 8)
        idx.write_labels(part.select("label"), f"{path}/{labels}")
    d = idx.read_dataset(spark, path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("split", "idx", "label", total(F.col("pixels")).alias("total"), total(vectors.binarize(F.col("pixels"))).alias("bright"), F.col("pixels")[0].cast("long").alias("first"))


@query("WITH e AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS idx, label FROM embeddings) SELECT idx, CAST(d AS INTEGER) AS digit, CASE WHEN label = d THEN 1 ELSE 0 END AS hot FROM e, range(10) t(d) WHERE idx >= 7")
def idx_categorical(spark, sf):
    path = _path(spark, "idx") + "/labels"
    idx.write_labels(table(spark, sf, "embeddings").orderBy("vec_id").select("label"), path)
    return idx.read_labels(spark, path, start=7, categorical=True).select("idx", F.posexplode("hot").alias("digit", "hot"))


# --- stores ------------------------------------------------------------------------


def _store(spark, sf, storage: str, partitioner=None) -> tuple[kv.Store, int]:
    store = kv.Store(spark)
    t = store.create(storage, partitioner=partitioner)
    for part in range(5):  # more batches than a table keeps unwritten
        store.add_rows(t, adds(spark, sf).filter(F.pmod(F.floor(F.col("seq") / 50), F.lit(5)) == part))
    return store, t


@query(f"WITH {OPS}, b AS (SELECT *, (seq // 50) % 5 AS part FROM ops WHERE flag = 'Add') SELECT key, arg_max(val, part * 1000000000 + seq) AS val FROM b GROUP BY key")
def kv_store_map(spark, sf):
    """A map table after five batches of writes: a later batch wins, whatever its numbers."""
    store, t = _store(spark, sf, "map")
    return store.state(t)


@query(f"WITH {STATE} SELECT key, val FROM state")
def kv_store_append(spark, sf):
    """An append table keeps the writes' own order."""
    store, t = _store(spark, sf, "append")
    return store.state(t)


@query(f"WITH s AS ({_jump_sql(3)}), {STATE} SELECT state.key, state.val, s.server FROM state JOIN s USING (key)")
def kv_store_slices(spark, sf):
    store, t = _store(spark, sf, "append", kv.Jump(3))
    return store.slices(t)


@query("""WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS node, count(*) AS num FROM nation WHERE n_regionkey <> 2 GROUP BY 1), w AS (SELECT CAST(r_regionkey AS BIGINT) AS node FROM region UNION ALL SELECT 77)
SELECT w.node, CASE WHEN w.node = 77 THEN -1 ELSE w.node * 1000 + 100 + greatest(coalesce(num, 0) - CASE WHEN w.node = 1 THEN 1 ELSE 0 END, 0) END AS tid FROM w LEFT JOIN n USING (node)""")
def worker_next(spark, sf):
    """Workers of all nations but those of region 2, one of region 1 deallocated; the thread each region's next worker gets."""
    n = table(spark, sf, "nation").filter("n_regionkey <> 2").groupBy(F.col("n_regionkey").cast("long").alias("node")).agg(F.count("*").alias("num"))
    nodes = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("node"))
    left = slices.deallocate_workers(slices.allocate_workers(n), spark.createDataFrame([(1, 1100)], "node long, tid long"))
    return slices.allocate_worker(nodes, left, nodes.union(spark.createDataFrame([(77,)], "node long")))


@query("SELECT n_nationkey, CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: ascii(c))) AS BIGINT) AS bytes FROM nation")
def bytes_sum(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", vectors.byte_sum(F.col("n_name").cast("binary")).alias("bytes"))


# --- tasks -------------------------------------------------------------------------


def _summed(info: job.Info, frames):
    n, total, table_ = 0, 0.0, next(iter(info.tables.values()))
    for f in frames:
        n, total = n + len(f), total + float(np.round(f["value"] * 1000).sum())
    table_.add([info.worker_id, 99], [float(n), float(info.worker_id)])
    info.report_time(total)
    yield pd.DataFrame({"worker_id": [info.worker_id], "tid": [info.thread_id], "n": [n], "seen": [table_.get([5])[0]]})


def _task(spark, sf) -> tuple[DataFrame, kv.Store, int]:
    store = kv.Store(spark)
    t = store.create()
    store.add(t, [5], [0.25])
    workers = slices.allocate_workers(spark.createDataFrame([(0, 2), (1, 2)], "node long, num long"))
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("worker_id"), "value")
    return job.Task(_summed, workers, [t]).run(rows, "worker_id long, tid long, n long, seen double", store), store, t


@query("SELECT user_id % 4 AS worker_id, CASE WHEN user_id % 4 < 2 THEN 100 + user_id % 4 ELSE 1098 + user_id % 4 END AS tid, count(*) AS n, 0.25::DOUBLE AS seen FROM events GROUP BY ALL")
def task_results(spark, sf):
    return _task(spark, sf)[0]


@query("SELECT user_id % 4 AS key, CAST(count(*) AS DOUBLE) AS val FROM events GROUP BY 1 UNION ALL SELECT 5, 0.25::DOUBLE UNION ALL SELECT 99, CAST(max(user_id % 4) AS DOUBLE) FROM events")
def task_writes(spark, sf):
    """What the workers wrote to the task's table; of several writes to a key the largest worker's stays."""
    _, store, t = _task(spark, sf)
    return store.state(t)


#: Goldens: 3 workers at speed 1, one ten times slower, rebalanced after every iteration.
@query("""SELECT * FROM (VALUES (0, 0, 100.0::DOUBLE, 100), (0, 1, 100.0, 100), (0, 2, 100.0, 100), (0, 3, 1000.0, 100), (1, 0, 107.0, 107), (1, 1, 107.0, 107), (1, 2, 106.0, 106), (1, 3, 800.0, 80),
  (2, 0, 113.0, 113), (2, 1, 112.0, 112), (2, 2, 111.0, 111), (2, 3, 640.0, 64)) t(iter, tid, time, workload)""")
def sched_simulation(spark, sf):
    return job.simulate(spark, {0: 1.0, 1: 1.0, 2: 1.0, 3: 10.0}, 3, rate=0)


# --- training ------------------------------------------------------------------------

HELD = 20  # samples of each worker


def _batches_sql(i: int, size: int, source: str, id_: str) -> str:
    return f"""r{i} AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY md5('0:{i}:' || {id_}), {id_}) - 1 AS place, count(*) OVER (PARTITION BY worker) AS many FROM {source}),
b{i} AS (SELECT r{i}.*, t.b FROM range({size}) t(b) JOIN r{i} ON t.b % many = place)"""


def _split_sql(workers: int, source: str, id_: str) -> str:
    return f"a0 AS (SELECT *, {id_} % {workers} AS worker FROM {source}), a1 AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY {id_} DESC) AS back FROM a0), tr AS (SELECT * FROM a1 WHERE back > {HELD}), te AS (SELECT * FROM a1 WHERE back <= {HELD})"


def _lr_sql(n_iters: int, size: int, alpha: float, workers: int) -> str:
    parts = [_split_sql(workers, "(SELECT vec_id FROM embeddings)", "vec_id"), f"w0 AS (SELECT unnest(range(65)) AS key, {START}::DOUBLE AS val)"]
    for i in range(n_iters):
        parts += [
            _batches_sql(i, size, "tr", "vec_id"),
            f"z{i} AS (SELECT s.vec_id, any_value(s.y) AS y, any_value(o.val) AS w0, any_value(o.val) + sum(w.val * s.x) AS score, sum(s.x) AS sx FROM s JOIN w{i} w ON w.key = s.idx JOIN w{i} o ON o.key = 0 GROUP BY s.vec_id)",
            f"g{i} AS (SELECT vec_id, w0, w0 + sx * (y - 1 / (1 + exp(-score))) AS g FROM z{i})",
            f"u{i} AS (SELECT 0 AS key, w0 + {alpha}::DOUBLE * g AS v, b, worker FROM b{i} JOIN g{i} USING (vec_id) UNION ALL SELECT s.idx, w.val + {alpha}::DOUBLE * g, b, worker FROM b{i} JOIN g{i} USING (vec_id) JOIN s USING (vec_id) JOIN w{i} w ON w.key = s.idx)",
            f"w{i + 1} AS (SELECT w.key, coalesce(x.v, w.val) AS val FROM w{i} w LEFT JOIN (SELECT key, arg_max(v, b * 1000 + worker) AS v FROM u{i} GROUP BY key) x USING (key))",
        ]
    return ",\n".join(parts)


def _mini(**more) -> Params:
    return Params(holdout=True, test_rows=HELD, scheduler=False, **more)


def _workers(s: DataFrame, n: int, by: str = "sample_id") -> DataFrame:
    return s.withColumn("worker", F.pmod(by, F.lit(n)).cast("long"))


@query(f"WITH {SAMPLES},\n{_lr_sql(2, 30, 0.1, 4)} SELECT key, round(val, 9) AS val FROM w2")
def lr_train(spark, sf):
    """Two supersteps over batches of 30 samples a worker, in an order drawn anew, the last 20 held out: the weights."""
    t = job.train_lr(_workers(samples(spark, sf), 4), start_weights(spark), _mini(n_iters=2, batch_size=30, alpha=0.1))
    return _rounded(t.state[0], "val", digits=9)


@query(f"""WITH {SAMPLES},\n{_lr_sql(2, 30, 0.1, 4)}, z AS (SELECT s.vec_id, any_value(s.y) AS y, any_value(o.val) + sum(w.val * s.x) AS score FROM s JOIN te USING (vec_id) JOIN w2 w ON w.key = s.idx JOIN w2 o ON o.key = 0 GROUP BY s.vec_id)
SELECT count(*) AS n, count(*) FILTER ((score > 0) = (y > 0)) AS n_correct FROM z""")
def lr_train_test(spark, sf):
    """The same, prefetching each batch's keys: right answers on the samples held out."""
    t = job.train_lr(_workers(samples(spark, sf), 4), start_weights(spark), _mini(n_iters=2, batch_size=30, alpha=0.1, prefetch=True))
    return models.accuracy(models.lr_predict(t.test, t.state[0], rows=65)).select("n", "n_correct")


def _svm_sql(n_iters: int, size: int, rate: float, lam: float, workers: int) -> str:
    parts = [_split_sql(workers, "(SELECT vec_id FROM embeddings)", "vec_id"), f"w0 AS (SELECT unnest(range(65)) AS key, {START}::DOUBLE AS val)"]
    for i in range(n_iters):
        parts += [
            _batches_sql(i, size, "tr", "vec_id"),
            f"z{i} AS (SELECT s.vec_id, 2 * any_value(s.y) - 1 AS y, coalesce(sum(w.val * s.x) FILTER (s.rn > 1), 0) AS score FROM s JOIN w{i} w ON w.key = s.idx GROUP BY s.vec_id)",
            f"""u{i} AS (SELECT s.idx AS key, b, worker, CASE WHEN s.rn = 1 THEN w.val WHEN z.y * z.score > 1 THEN w.val - {rate}::DOUBLE * {lam}::DOUBLE * w.val ELSE w.val - {rate}::DOUBLE * ({lam}::DOUBLE * w.val - z.y * s.x) END AS v
  FROM b{i} JOIN z{i} z USING (vec_id) JOIN s USING (vec_id) JOIN w{i} w ON w.key = s.idx)""",
            f"w{i + 1} AS (SELECT w.key, coalesce(x.v, w.val) AS val FROM w{i} w LEFT JOIN (SELECT key, arg_max(v, b * 1000 + worker) AS v FROM u{i} GROUP BY key) x USING (key))",
        ]
    return ",\n".join(parts)


@query(f"WITH {SAMPLES},\n{_svm_sql(2, 200, 0.5, 0.01, 4)} SELECT key, round(val, 7) AS val FROM w2")
def svm_train(spark, sf):
    """Two supersteps of batches that come round again where a worker has fewer samples."""
    t = job.train_svm(_workers(samples(spark, sf, 1, -1), 4), start_weights(spark), _mini(n_iters=2, batch_size=200, learning_rate=0.5, lam=0.01))
    return _rounded(t.state[0], "val", digits=7)


_GRID = {"batch_size": [5, 30], "n_workers_per_node": [2, 4]}


def _sweep_sql() -> str:
    jobs = sweep(_mini(n_iters=1, alpha=0.1), **_GRID)
    ctes = [f"{p.job_name} AS (WITH {_lr_sql(1, p.batch_size, p.alpha, p.n_workers_per_node)} SELECT '{p.job_name}' AS job_name, key, round(val, 9) AS val FROM w1)" for p in jobs]
    return f"WITH {SAMPLES},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(f"SELECT * FROM {p.job_name}" for p in jobs)


@query(_sweep_sql())
def sweep_lr(spark, sf):
    """The weights after a superstep of each job of a grid over batch sizes and workers."""
    jobs = sweep(_mini(n_iters=1, alpha=0.1), **_GRID)
    out = None
    for p, t in job.swept(samples(spark, sf).drop("worker"), start_weights(spark), jobs):
        w = _rounded(t.state[0], "val", digits=9).select(F.lit(p.job_name).alias("job_name"), "key", "val")
        out = w if out is None else out.unionByName(w)
    return out


def _mf_sql(n_iters: int, size: int, workers: int) -> str:
    """Rank 2. Blank factors read as 0.01; the item's update uses the user's new factors."""
    a, b = "0.01::DOUBLE", "0.02::DOUBLE"
    blank = "CAST({} AS DOUBLE) AS {}"
    none = "SELECT CAST(0 AS BIGINT) AS id, " + ", ".join(blank.format(0, c) for c in ("bias", "f1", "f2")) + " WHERE false"
    read = lambda t, c: f"CASE WHEN coalesce({t}.{c}, 0) = 0 THEN 0.01::DOUBLE ELSE {t}.{c} END"
    parts = [f"us0 AS ({none}), it0 AS ({none})", _split_sql(workers, "r", "pos")]
    for i in range(n_iters):
        parts += [
            _batches_sql(i, size, "tr", "pos").replace(f"r{i} AS", f"rr{i} AS").replace(f"r{i}.*", f"rr{i}.*").replace(f"JOIN r{i} ", f"JOIN rr{i} "),
            f"""j{i} AS (SELECT b.b, b.worker, b."user", b.item, b.rating, coalesce(u.bias, 0) AS bu, coalesce(v.bias, 0) AS bi, {read('u', 'f1')} AS u1, {read('u', 'f2')} AS u2, {read('v', 'f1')} AS v1, {read('v', 'f2')} AS v2
  FROM b{i} b LEFT JOIN us{i} u ON u.id = b."user" LEFT JOIN it{i} v ON v.id = b.item)""",
            f"e{i} AS (SELECT *, rating - (mu + bu + bi + u1 * v1 + u2 * v2) AS e FROM j{i}, mu)",
            f"n{i} AS (SELECT *, u1 + {a} * (e * v1 - {b} * u1) AS nu1, u2 + {a} * (e * v2 - {b} * u2) AS nu2, bu + {a} * (e - {b} * bu) AS nbu, bi + {a} * (e - {b} * bi) AS nbi FROM e{i})",
            f"p{i} AS (SELECT *, v1 + {a} * (e * nu1 - {b} * v1) AS nv1, v2 + {a} * (e * nu2 - {b} * v2) AS nv2, b * 1000 + worker AS o FROM n{i})",
        ]
        for name, id_, cols in (("us", '"user"', ("nbu", "nu1", "nu2")), ("it", "item", ("nbi", "nv1", "nv2"))):
            new = ", ".join(f"arg_max({c}, o) AS x{k}" for k, c in enumerate(cols))
            parts.append(f"{name}{i + 1} AS (SELECT coalesce(n.id, o.id) AS id, coalesce(x0, bias) AS bias, coalesce(x1, f1) AS f1, coalesce(x2, f2) AS f2 FROM {name}{i} o FULL JOIN (SELECT {id_} AS id, {new} FROM p{i} GROUP BY 1) n ON n.id = o.id)")
    return ",\n".join(parts)


def _mf_trained(spark, sf) -> tuple[job.Trained, float]:
    mean = float(models.mean_rating(ratings(spark, sf)).first()[0])
    none = spark.createDataFrame([], "id long, bias double, f array<double>")
    return job.train_mf(_workers(ratings(spark, sf), 4, "pos"), none, none, mean, _mini(n_iters=2, batch_size=300, alpha=0.01, rank=2)), mean


@query(f"""WITH {RATINGS},\n{_mf_sql(2, 300, 4)}, x AS (SELECT 'user' AS side, * FROM us2 UNION ALL SELECT 'item', * FROM it2)
SELECT side, id, CAST(l AS INTEGER) AS l, round(CASE l WHEN -1 THEN bias WHEN 0 THEN f1 ELSE f2 END, 8) AS val FROM x, range(-1, 2) t(l)""")
def mf_train(spark, sf):
    """Two supersteps of factorization: the second reads the factors that the first stored."""
    t, _ = _mf_trained(spark, sf)
    return _rounded(models.factors_long("user", t.state[0]).unionByName(models.factors_long("item", t.state[1])), "val", digits=8)


_FITTED = """SELECT c.pos, mu + coalesce(u.bias, 0) + coalesce(v.bias, 0) + {0} AS predicted, c.rating FROM {1} c CROSS JOIN mu LEFT JOIN us2 u ON u.id = c."user" LEFT JOIN it2 v ON v.id = c.item"""
_SEEN = " + ".join(f"CASE WHEN coalesce(u.{f}, 0) = 0 THEN 0.01::DOUBLE ELSE u.{f} END * CASE WHEN coalesce(v.{f}, 0) = 0 THEN 0.01::DOUBLE ELSE v.{f} END" for f in ("f1", "f2"))
_PLAIN = " + ".join(f"coalesce(u.{f}, 0) * coalesce(v.{f}, 0)" for f in ("f1", "f2"))


@query(f"WITH {RATINGS},\n{_mf_sql(2, 300, 4)}, p AS ({_FITTED.format(_SEEN, 'te')}) SELECT pos, round(predicted, 7) AS predicted, round(rating - predicted, 7) AS err FROM p")
def mf_predict_trained(spark, sf):
    t, mean = _mf_trained(spark, sf)
    a = models.attach_factors(t.test, *t.state, 2, 0.01)
    return _rounded(models.mf_predict(a, mean).select("pos", "predicted", "err"), "predicted", "err", digits=7)


@query(f"""WITH {RATINGS},\n{_mf_sql(2, 300, 4)}, c AS (SELECT "user", item, arg_max(rating, pos) AS rating, max(pos) AS pos FROM (SELECT * FROM r ORDER BY pos LIMIT 5000) GROUP BY "user", item), p AS ({_FITTED.format(_PLAIN, 'c')})
SELECT CAST((SELECT mu FROM mu) AS BIGINT) AS mean_rating, round(sqrt(sum((rating - predicted) * (rating - predicted))), 6) AS sse_root, round(sqrt(avg((rating - predicted) * (rating - predicted))), 6) AS rmse FROM p""")
def mf_error_trained(spark, sf):
    t, _ = _mf_trained(spark, sf)
    r = ratings(spark, sf)
    return _rounded(models.mf_error(r, *t.state, models.mean_rating(r), rank=2), "sse_root", "rmse")


# --- streams --------------------------------------------------------------------------


def _log_files(spark, sf) -> str:
    path = _path(spark, "log")
    op_log(spark, sf).write.parquet(path)
    return path


@query(f"WITH {OPS} SELECT key, max(seq) AS seq, arg_max(val, seq) AS val FROM ops WHERE flag = 'Add' GROUP BY key")
def stream_upsert(spark, sf):
    """A stream of operations, all there is of it so far, kept as a table."""
    out = _path(spark, "live")
    oplog.upsert_batches(oplog.read_log(spark, _log_files(spark, sf)), out, _path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return oplog.read_table(spark, out)


@query(f"WITH {OPS} SELECT g.seq, g.tid, g.key, coalesce(arg_max(a.val, a.seq), 0) AS val FROM ops g LEFT JOIN ops a ON a.flag = 'Add' AND a.key = g.key AND a.seq < g.seq WHERE g.flag = 'Get' GROUP BY g.seq, g.tid, g.key")
def stream_asp(spark, sf):
    """Gets answered by a stateful operator, in one micro-batch."""
    out = _path(spark, "answers")
    answers = oplog.asp_answers(oplog.read_log(spark, _log_files(spark, sf)))
    answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, tid long, key long, val double").parquet(out)
