"""Goldens and brute-force comparisons of the core operators."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyflux.functions.jump import jump_buckets
from keyflux.operators import clocks, kv, models, ordered, schedule, slices, stats
from keyflux.plans import job
from keyflux.plans.params import Params, sweep
from keyflux.sources import idx, text
from keyflux.streaming import oplog


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_jump_hash_goldens(spark):
    assert jump_buckets(np.arange(14), 3).tolist() == [0, 0, 0, 2, 1, 1, 2, 0, 0, 2, 2, 2, 1, 0]
    keys = spark.createDataFrame([(i, k) for i, k in enumerate([2, 8, 9, 10, 11, 12, 13])], "pos int, key long")
    got = [(r["server"], r["keys"]) for r in slices.slice_batches(slices.jump_slice(keys, 3)).collect()]
    assert got == [(0, [2, 8, 13]), (2, [9, 10, 11]), (1, [12])]
    pairs = slices.slice_batches(slices.jump_slice(keys.withColumn("val", F.col("key") / 10), 3), val="val", size=2).collect()
    assert [(r["server"], r["batch"], r["keys"], r["vals"]) for r in pairs] == [(0, 0, [2, 8], [0.2, 0.8]), (2, 0, [9, 10], [0.9, 1.0]), (2, 1, [11], [1.1]), (1, 0, [12], [1.2]), (0, 1, [13], [1.3])]


@given(st.integers(0, 2**62), st.integers(1, 50))
def test_jump_hash_moves_only_to_the_new_bucket(key, n):
    a, b = jump_buckets(np.array([key]), n)[0], jump_buckets(np.array([key]), n + 1)[0]
    assert 0 <= a < n and b in (a, n)


def test_jump_hash_by_hand():
    def one(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    assert jump_buckets(np.arange(10_000), 7).tolist() == [one(k, 7) for k in range(10_000)]


def test_range_slices(spark):
    keys = spark.createDataFrame([(2,), (8,), (9,), (1,), (99,)], "key long")
    want = [(1, 2), (2, 0), (8, 2), (9, 2), (99, 2)]
    assert rows(slices.range_slice(keys, [(2, 4), (4, 7), (7, 10)])) == want
    table = lambda r: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(r)], "server int, first long, stop long")
    assert rows(slices.range_slice_table(keys, table([(2, 4), (4, 7), (7, 10)]))) == want
    rnd = random.Random(4)
    many = [(a, a + rnd.randrange(0, 90)) for a in (rnd.randrange(-500, 500) for _ in range(40))]
    got = dict(rows(slices.range_slice_table(spark.range(-600, 700).withColumnRenamed("id", "key"), table(many))))
    order = sorted((a, b, i) for i, (a, b) in enumerate(many))
    assert got == {k: next((i for a, b, i in order if a <= k < b), order[-1][2]) for k in range(-600, 700)}


def test_id_mapping(spark):
    nodes = spark.createDataFrame([(0,), (1,), (3,)], "node long")
    assert [r[1] for r in rows(slices.server_threads(nodes, 3))] == [0, 1, 2, 1000, 1001, 1002, 3000, 3001, 3002]
    assert [r[1] for r in rows(slices.helper_threads(nodes))] == [50, 1050, 3050]
    with pytest.raises(ValueError):
        slices.server_threads(nodes, 50)
    spec = spark.createDataFrame([(0, 3), (1, 2)], "node long, num long")
    workers = slices.allocate_workers(spec)
    assert rows(workers) == [(0, 0, 100), (1, 0, 101), (2, 0, 102), (3, 1, 1100), (4, 1, 1101)]
    left = slices.deallocate_workers(workers, spark.createDataFrame([(0, 102), (7, 1)], "node long, tid long"))
    assert rows(slices.threads_of(left, 0), "tid") == [(100,), (101,)] and slices.threads_of(left, 9).count() == 0
    assert rows(slices.allocate_worker(nodes, left, spark.createDataFrame([(0,), (3,), (5,)], "node long"))) == [(0, 102), (3, 3100), (5, -1)]


def test_store(spark):
    s = kv.Store(spark)
    for storage in ("map", "append"):
        t = s.create(storage)
        s.add(t, [13, 14, 15], [1, 2, 3])
        s.add(t, [14, 14], [5, 6])
        assert [tuple(r) for r in s.get(t, [15, 14, 14, 99]).collect()] == [(14, 6.0), (15, 3.0), (99, 0.0)]
    with pytest.raises(ValueError):
        s.add(t, [1, 2], [1.0])
    s.reset_workers(t, [2, 7])
    assert [s.clock(t, w) for w in (2, 7, 7, 7, 2)] == [-1, 1, -1, -1, 2]


def log_of(spark, ops):
    return spark.createDataFrame([(i, 0, t, f, k, v) for i, (f, t, k, v) in enumerate(ops)], "seq long, model_id int, tid long, flag string, key long, val double")


def test_visibility_goldens(spark):
    asp = [("Get", 2, 0, 0.0), ("Get", 3, 1, 0.0), ("Get", 3, 1, 0.0), ("Add", 2, 1, 1.0), ("Clock", 2, 0, 0.0), ("Get", 2, 1, 0.0), ("Add", 3, 0, 1.0), ("Clock", 3, 0, 0.0), ("Get", 3, 0, 0.0)]
    assert [r[3] for r in rows(clocks.asp_get(log_of(spark, asp)))] == [0, 0, 0, 1, 1]
    bsp = [("Get", 2, 1, 0.0), ("Add", 2, 1, 100.0), ("Clock", 2, 0, 0.0), ("Get", 3, 1, 0.0), ("Clock", 3, 0, 0.0), ("Get", 3, 1, 0.0)]
    assert [r[3] for r in rows(clocks.bsp_get(log_of(spark, bsp)))] == [0, 0, 100]
    assert rows(clocks.bsp_pending_adds(log_of(spark, bsp))) == [(2, 1), (4, 0)]
    ssp = [("Add", 2, 0, 1.0), ("Add", 3, 1, 2.0), ("Get", 2, 0, 0.0), ("Get", 3, 1, 0.0)]
    assert [r[3] for r in rows(clocks.ssp_get(log_of(spark, ssp), 1))] == [1, 2]
    wait = [("Get", 2, 0, 0.0), ("Clock", 2, 0, 0.0), ("Add", 2, 0, 1.0), ("Clock", 2, 0, 0.0), ("Clock", 2, 0, 0.0), ("Get", 2, 0, 0.0), ("Get", 3, 0, 0.0)]
    assert rows(clocks.ssp_pending(log_of(spark, wait), 2)) == [(1, 1)]


def replay(ops, tids, mode, staleness=0):
    """A server that handles one operation after the other."""
    clock, state, buffered, parked, out = dict.fromkeys(tids, 0), {}, [], [], {}
    for seq, (flag, t, k, v) in enumerate(ops):
        if flag == "Add":
            if mode == "bsp":
                buffered.append((k, v))
            else:
                state[k] = v
        elif flag == "Get":
            if mode == "asp" or clock[t] <= min(clock.values()) + staleness:
                out[seq] = state.get(k, 0.0)
            else:
                parked.append((seq, k, clock[t] - staleness))
        else:
            before = min(clock.values())
            clock[t] += 1
            if min(clock.values()) > before:
                state.update(dict(buffered))
                buffered = []
                for s, key, due in parked:
                    if due <= min(clock.values()):
                        out.setdefault(s, state.get(key, 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_visibility_against_replay(spark, seed):
    rnd = random.Random(seed)
    ops = [(rnd.choice(["Add", "Add", "Get", "Clock"]), rnd.randrange(3), rnd.randrange(5), float(i)) for i in range(300)]
    log = log_of(spark, ops)
    answers = lambda df: {r["seq"]: r["val"] for r in df.collect()}
    assert answers(clocks.asp_get(log, width=16)) == replay(ops, range(3), "asp")
    assert answers(clocks.bsp_get(log, [0, 1, 2], width=16)) == replay(ops, range(3), "bsp")
    for s in (0, 2):
        assert answers(clocks.ssp_get(log, s, [0, 1, 2], width=16)) == replay(ops, range(3), "ssp", s)


def test_clocks_of_many_workers(spark, monkeypatch):
    rnd = random.Random(8)
    ops = [(rnd.choice(["Add", "Get", "Clock", "Clock"]), rnd.randrange(5), 0, 0.0) for _ in range(300)]
    log = log_of(spark, ops)
    pick = lambda d: rows(d.filter("tid < 4"), "seq", "tid", "mn", "ck", "prev")
    want = pick(clocks.clocked(log, [0, 1, 2, 3], width=16))
    monkeypatch.setattr(clocks, "COLUMNS", 0)
    assert pick(clocks.clocked(log, [0, 1, 2, 3], width=16)) == want


def test_the_shared_folder_is_named_on_a_cluster():
    from types import SimpleNamespace

    from keyflux.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_running_sums_by_ranges(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    out = ordered.running_sums(df, "id", {"s": F.col("id")}, by=("g",), width=64)
    got = {r["id"]: r["s"] for r in out.collect()}
    assert all(got[i] == sum(range(i % 2, i + 1, 2)) for i in range(1000))


def test_rebalance_goldens(spark):
    for times, loads, want in (([10, 10, 10, 100], [100] * 4, [107, 107, 106, 80]), ([10, 40, 12, 100], [100] * 4, [120, 80, 120, 80]), ([5, 30, 30, 30], [10, 7, 8, 9], [15, 6, 6, 7])):
        df = spark.createDataFrame([(0, i, float(t), w) for i, (t, w) in enumerate(zip(times, loads))], "iter int, tid long, time double, old_w int")
        got = [r["new_w"] for r in schedule.rebalance(df).orderBy("tid").collect()]
        assert got == want and sum(got) == sum(loads)


def test_delays_at_random(spark):
    times = spark.range(2000).select(F.lit(3).alias("iter"), (F.col("id") % 10).alias("worker_id"), F.lit(1.0).alias("time"))
    got = [r["time"] for r in schedule.injected_delay(times, 200.0, probability=0.25).collect()]
    assert set(got) == {1.0, 3.0} and 0.2 < got.count(3.0) / 2000 < 0.3
    assert not [r for r in schedule.injected_delay(times, 200.0).collect() if r["time"] != 1.0]


def test_session_settings(spark):
    from keyflux.session import session

    s = session()
    assert s.conf.get("spark.sql.session.timeZone") == "UTC" and s.conf.get("spark.sql.adaptive.enabled") == "true"


def test_reading_ahead_hands_on_errors_and_stops():
    def items():
        yield from range(5)
        raise ValueError("broken")

    got = []
    with pytest.raises(ValueError, match="broken"):
        for x in text.prefetched(items()):
            got.append(x)
    assert got == list(range(5)) and next(text.prefetched(iter(range(10**9)))) == 0


def test_simulation_converges(spark):
    out = job.simulate(spark, {0: 1.0, 1: 1.0, 2: 1.0, 3: 10.0}, 12, rate=0).collect()
    spread = lambda i: max(r["time"] for r in out if r["iter"] == i)
    assert spread(11) < spread(0) / 4 and all(sum(r["workload"] for r in out if r["iter"] == i) == 400 for i in range(12))


def test_statistics(spark):
    t = spark.createDataFrame([(0, i, 1_000_000 * i) for i in range(10)], "tid long, seq long, dur_us long")
    r = stats.last_n(t, {"a": 1, "b": 5, "c": 100}).first()
    assert (r["a"], r["b"], r["c"]) == (9_000_000, 35_000_000, 45_000_000)
    s = stats.summary(t, throw_away=1).first()
    assert (s["n"], s["mean"]) == (9, 5_000_000)
    timer = stats.Timer()
    timer.start(), timer.pause(), timer.resume(), timer.stop()
    assert timer.measure(lambda x: x + 1, 4) == 5 and len(timer.times) == 2
    assert stats.measure(lambda: 7, repeat=2, warm_up=1)[0] == 7


def test_parsers(spark, tmp_path):
    lines = spark.createDataFrame([("-1 35:1 48:1 70:1 149:1 250:1",), ("20 99:1.1 207:1.2 208:1.3 225:1.4",), ("  ",), ("3",)], "value string")
    got = sorted((r["label"], round(sum(r["features"].values()), 6)) for r in text.parse_libsvm(lines).collect())
    assert got == [(-1, 5.0), (3, 0), (20, 5.0)]
    (tmp_path / "m").write_text("# nodes\n0:proj6:62353\n1:proj7:62354")
    assert rows(text.parse_nodes(text.read_lines(spark, str(tmp_path / "m")))) == [(0, "proj6", 62353), (1, "proj7", 62354)]
    (tmp_path / "l").write_bytes(b"a\r\nb\n\nc")
    assert sorted(r[0] for r in text.read_lines(spark, str(tmp_path / "l")).collect()) == ["", "a\r", "b", "c"]
    (tmp_path / "r").write_text("1\t2\t5\n3\t4\t1\n7\t8\t2")
    loaded = text.load(spark, str(tmp_path / "r"), text.parse_ratings)
    assert rows(loaded) == [(1, 2, 5), (3, 4, 1), (7, 8, 2)] and [len(b) for b in text.batches(loaded, 2)] == [2, 1]
    assert text.list_files(spark, str(tmp_path / "l")).first()["blocks"] == 1
    urls = spark.createDataFrame([("hdfs://u:p@h:9001/a/b?x=1#f",), ("hdfs:///data",), ("nothing",)], "url string")
    got = {r["url"]: (r["valid"], r["host"], r["port"], r["path"], r["user"]) for r in text.parse_url(urls, "url", ["url"]).collect()}
    odd = ["mailto:x", "http:/a/b", "http://h:12ab/p", "a1://h", "://h/x", "http://a:b:c@h/p", "http://u@h:1", "http://[::1]:80/x", "http://[::1]x", "http://[::1", "http://h?q/p?x#y#z", "http://h/p#f?x", "", "http://", "http://h:ab/"]
    parts = {r["url"]: tuple(r)[1:] for r in text.parse_url(spark.createDataFrame([(u,) for u in [*odd, None]], "url string"), "url", ["url"]).collect()}
    bad = (False, "", "", "", "localhost", 9000, "", "", "")
    assert [parts[u] for u in ("mailto:x", "http:/a/b", "a1://h", "http://[::1]x", "", None)] == [bad] * 6
    assert parts["http://h:12ab/p"][4:7] == ("h", 12, "p") and parts["://h/x"][:7] == (True, "", "", "", "h", 9000, "x") and parts["http://h:ab/"][4:6] == ("h", None)
    assert parts["http://a:b:c@h/p"][2:6] == ("a", "b:c", "h", 9000) and parts["http://u@h:1"][2:6] == ("u", "", "h", 1) and parts["http://[::1]:80/x"][4:7] == ("[::1]", 80, "x")
    assert parts["http://[::1"][4] == "[::1" and parts["http://h?q/p?x#y#z"][4:] == ("h?q", 9000, "p", "x", "y#z") and parts["http://h/p#f?x"][6:] == ("p", "", "f?x") and parts["http://"][:5] == (True, "http", "", "", "localhost")
    assert got["hdfs://u:p@h:9001/a/b?x=1#f"] == (True, "h", 9001, "a/b", "u") and got["hdfs:///data"][1:4] == ("localhost", 9000, "data") and not got["nothing"][0]


def test_idx_files(spark, tmp_path):
    images = np.arange(3 * 4, dtype=np.uint8).reshape(3, 4)
    for split, (i, l) in idx.FILES.items():
        (tmp_path / i).write_bytes(struct.pack(">IIII", 0x803, 3, 2, 2) + images.tobytes())
        (tmp_path / l).write_bytes(struct.pack(">II", 0x801, 3) + bytes([7, 0, 9]))
    d = idx.read_dataset(spark, str(tmp_path), train_limit=2)
    assert rows(d, "split", "idx", "label") == [("test", 0, 7), ("test", 1, 0), ("test", 2, 9), ("train", 0, 7), ("train", 1, 0)]
    assert idx.read_labels(spark, str(tmp_path / idx.FILES["train"][1]), categorical=True).orderBy("idx").first()["hot"] == [0] * 7 + [1, 0, 0]
    assert idx.read_images(spark, str(tmp_path / idx.FILES["train"][0]), start=1, limit=1).first()["pixels"] == [4, 5, 6, 7]
    z = idx.normalized(d).first()["pixels"]
    assert abs(sum(z)) < 1e-9 and abs(sum(x * x for x in z) / 4 - 1) < 1e-9
    assert [r["pixels"] for r in idx.binarized(d, 5).filter("split = 'test'").orderBy("idx").collect()] == [[0] * 4, [0, 0, 1, 1], [1] * 4]
    twice = idx.read_images(spark, str(tmp_path / idx.FILES["train"][0]), limit=1, function=lambda p: F.transform(p, lambda x: x * 2))
    assert twice.first()["pixels"] == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        idx.decode(struct.pack(">II", 0x801, 5), 0x801)


def test_models_learn_and_tasks_run(spark):
    rnd = np.random.default_rng(0)
    data = []
    for i in range(60):
        y = i % 2
        data.append((i, y, i // 4, i % 4, [(1, float(4 * y - 2 + rnd.normal() * 0.1))]))
    s = spark.createDataFrame(data, "sample_id long, y int, b long, worker long, features array<struct<idx:int,x:double>>")
    w = spark.createDataFrame([(k, 0.0) for k in range(3)], "key long, val double")
    trained = job.train_lr(s, w, Params(n_iters=4, batch_size=15, alpha=0.5), compat=False)
    assert models.accuracy(models.lr_predict(s, trained.state[0])).first()["accuracy"] > 90
    with pytest.raises(ValueError):
        Params().checked()


def test_tasks_use_tables_and_report_times(spark):
    alloc = slices.allocate_workers(spark.createDataFrame([(0, 4)], "node long, num long"))
    store = kv.Store(spark)
    t = store.create("map")
    store.add(t, [7], [0.5])
    assert not job.Task().is_set_up()

    def count(info, frames):
        import pandas as pd

        n = sum(len(f) for f in frames)
        info.tables[0].add([info.worker_id, 9], [n + info.tables[0].get([7])[0], float(info.worker_id)])
        info.report_time(10.0 * (1 + 9 * (info.worker_id == 3)))
        yield pd.DataFrame({"worker_id": [info.worker_id], "n": [n], "tid": [info.thread_id]})

    task = job.Task(count, alloc, [t], scheduler=schedule.rebalance)
    data = spark.range(60).select((F.col("id") % 4).alias("worker_id"), "id")
    assert rows(task.run(data, "worker_id long, n long, tid long", store)) == [(i, 15, 100 + i) for i in range(4)]
    assert rows(store.state(t)) == [(0, 15.5), (1, 15.5), (2, 15.5), (3, 15.5), (7, 0.5), (9, 3.0)]
    assert task.workloads == {100: 107, 101: 107, 102: 106, 103: 80}


def _planned_at_run_time(spark):
    """A task over rows too many to be joined by a broadcast, until adaptive execution sees how few the workers are."""
    import pandas as pd

    def count(info, frames):
        n = sum(len(f) for f in frames)
        info.tables[0].add([info.worker_id], [float(n)])
        yield pd.DataFrame({"worker_id": [info.worker_id], "n": [n]})

    store = kv.Store(spark)
    t = store.create()
    alloc = slices.allocate_workers(spark.createDataFrame([(0, 4)], "node long, num long"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        out = rows(job.Task(count, alloc, [t]).run(spark.range(4000, numPartitions=6).select((F.col("id") % 4).alias("worker_id"), "id"), "worker_id long, n long", store))
    finally:
        for name in conf:
            spark.conf.unset(name)
    return out, store, t


def test_a_worker_is_one_task_however_its_rows_are_joined(spark):
    assert _planned_at_run_time(spark)[0] == [(i, 1000) for i in range(4)]


def test_a_worker_writes_once_however_its_rows_are_joined(spark):
    _, store, t = _planned_at_run_time(spark)
    assert rows(store.state(t)) == [(i, 1000.0) for i in range(4)]


def test_task_writes_is_its_sql_however_its_rows_are_joined(spark, tmp_path):
    """The query over events in several files, too many to be joined by a broadcast until adaptive execution sees how few the workers are."""
    import duckdb

    from keyflux import queries

    spark.range(4003, numPartitions=6).select(F.col("id").alias("user_id"), F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        got = rows(queries.queries()["task_writes"](spark, str(tmp_path)))
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert got == sorted(duck.sql(queries.oracle_sql()["task_writes"]).fetchall()) == [(0, 1001.0), (1, 1001.0), (2, 1001.0), (3, 1000.0), (5, 0.25), (99, 3.0)]


def test_training_honours_its_parameters(spark):
    """Against supersteps in plain Python: batches in an order drawn anew, hold-out, scheduler, injected delays; prefetch and joins give the same."""
    import hashlib

    rnd = np.random.default_rng(5)
    data = [(i, i % 2, i % 4, [(k, float(rnd.normal())) for k in sorted(rnd.choice(np.arange(1, 8), 3, replace=False).tolist())]) for i in range(50)]
    s = spark.createDataFrame(data, "sample_id long, y int, worker long, features array<struct<idx:int,x:double>>")
    w0 = spark.createDataFrame([(k, 0.1) for k in range(8)], "key long, val double")
    p = Params(n_iters=5, batch_size=14, alpha=0.2, holdout=True, test_rows=3, refresh_rate=2, permanent=True, straggler_percent=900.0)

    def plain():
        w, published = {k: 0.1 for k in range(8)}, dict.fromkeys(range(4), 14)
        loads, seen = dict(published), []
        for i in range(5):
            if i % 2 == 0:
                loads = dict(published)
            push = {}
            for worker in range(4):
                mine = sorted(d[0] for d in data if d[2] == worker)[:-3]
                mine.sort(key=lambda k: (hashlib.md5(f"0:{i}:{k}".encode()).hexdigest(), k))  # noqa: B023
                for b in range(loads[worker]):
                    _, y, _, f = data[mine[b % len(mine)]]
                    score = w[0] + sum(w[k] * x for k, x in f)
                    g = w[0] + sum(x for _, x in f) * (y - 1 / (1 + np.exp(-score)))
                    for k in [0, *(k for k, _ in f)]:
                        push[k] = max(push.get(k, (-1, -1, 0)), (b, worker, w[k] + 0.2 * g))
            w |= {k: v for k, (_, _, v) in push.items()}
            times = {t: loads[t] * (10.0 if t == 3 else 1.0) for t in range(4)}
            seen += [(i, t, loads[t], times[t]) for t in range(4)]
            if i % 3 == 0:
                slow = [t for t in times if times[t] > 1.5 * min(times.values())]
                pool = sum(int(0.2 * published[t] + 0.5) for t in slow)
                published = {t: int(0.8 * published[t] + 0.5) if t in slow else published[t] for t in published}
                left = 4 - len(slow)
                for t in sorted((t for t in times if t not in slow), key=lambda t: (times[t], t)):
                    give = int(pool / left + 0.5)
                    published[t] += give
                    pool, left = pool - give, left - 1
                    if pool < 1:
                        break
        return w, seen

    w, seen = plain()
    for trained in (job.train_lr(s, w0, p), job.train_lr(s, w0, Params(**{**vars(p), "prefetch": True}))):
        got = dict(rows(trained.state[0]))
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in w.items()} and trained.report == [(i, t, n, pytest.approx(x)) for i, t, n, x in seen]
        assert trained.test.count() == 12
    models_dense, models.DENSE_ROWS = models.DENSE_ROWS, 0
    try:
        got = dict(rows(job.train_lr(s, w0, Params(**{**vars(p), "n_iters": 2, "prefetch": True})).state[0]))
    finally:
        models.DENSE_ROWS = models_dense
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in rows(job.train_lr(s, w0, Params(**{**vars(p), "n_iters": 2})).state[0])}
    jobs = sweep(Params(n_iters=1, alpha=0.2), batch_size=[1, 12], n_workers_per_node=[1, 2])
    results = [rows(t.state[0]) for _, t in job.swept(s, w0, jobs)]
    assert len({str(r) for r in results}) == 4


def test_factorization_by_hand(spark):
    r = spark.createDataFrame([(0, 1, 1, 5), (1, 1, 2, 3), (2, 2, 1, 1)], "pos long, user long, item long, rating int")
    none = spark.createDataFrame([], "id long, bias double, f array<double>")
    users, items = models.mf_step(r, none, none, 3.0, rank=2, alpha=0.1, beta=0.02)
    e = 3 - (3 + 2 * 0.01**2)
    got = {x["id"]: x for x in users.collect()}
    assert abs(got[1]["bias"] - 0.1 * e) < 1e-12 and abs(got[1]["f"][0] - (0.01 + 0.1 * (e * 0.01 - 0.02 * 0.01))) < 1e-12
    assert models.mean_rating(r).first()[0] == 3


def test_live_log(spark, tmp_path):
    ops = [("Add", 0, 1, 5.0), ("Get", 0, 1, 0.0), ("Add", 0, 1, 7.0), ("Get", 1, 2, 0.0)]
    log_of(spark, ops).write.parquet(str(tmp_path / "in"))
    stream = oplog.read_log(spark, str(tmp_path / "in"))
    q = oplog.asp_answers(stream).writeStream.format("memory").queryName("answers").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("answers"), "seq", "val") == [(1, 5.0), (3, 0.0)]
    q = oplog.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(oplog.read_table(spark, str(tmp_path / "out"))) == [(1, 2, 7.0)]
    writer = oplog.upsert_batches(stream, str(tmp_path / "out2"), str(tmp_path / "cp2"), compact=2)
    for i in range(3):
        q = writer.start()
        q.processAllAvailable()
        q.stop()
        spark.createDataFrame([(10 + i, 0, 0, "Add", i, float(i))], stream.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(oplog.read_table(spark, str(tmp_path / "out2"))) == [(0, 10, 0.0), (1, 11, 1.0)]
    assert sorted(p.name for p in (tmp_path / "out2").iterdir()) == ["d2", "t1"]
