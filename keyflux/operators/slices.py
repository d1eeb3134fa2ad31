"""Which server owns a key, and numbering of servers, workers and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jump import jump_hash
from .ordered import RANGE, running_sums

# Threads of a node are numbered within its thousand; servers from 0, helpers from 50, workers from 100.
NODE, HELPERS, WORKERS = 1000, 50, 100


def jump_slice(keys: DataFrame, servers: int) -> DataFrame:
    """keys (and values) with the server that jump consistent hashing gives."""
    return keys.withColumn("server", jump_hash(F.col("key"), servers))


def range_server(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Server by half-open ranges, in order; a key outside of all belongs to the last."""
    out = F.when(F.lit(False), 0)
    for i, (a, b) in enumerate(ranges):
        out = out.when((key >= a) & (key < b), i)
    return out.otherwise(len(ranges) - 1).cast("int")


def range_slice(keys: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    return keys.withColumn("server", range_server(F.col("key"), ranges))


def range_slice_table(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """As range_slice, for a table (server, first, stop) of any size; of overlapping ranges the one that begins first counts.

    Keys and ranges meet in buckets of the key's values, about four to a range,
    by an equi-join; the driver gets the ranges' number, ends and last row.
    """
    n, low, high, last = ranges.agg(F.count("*"), F.min("first"), F.max("stop"), F.max(F.struct("first", "stop", "server"))).first()
    width = max(1, (high - low) // (4 * n)) if n else 1
    cover = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("stop") - 1) / width)))
    r = ranges.filter("stop > first").select("first", "stop", "server", cover.alias("_bucket"))
    k = keys.select("key").distinct().withColumn("_bucket", F.floor(F.col("key") / width))
    hit = k.join(r, (k["_bucket"] == r["_bucket"]) & (F.col("key") >= F.col("first")) & (F.col("key") < F.col("stop")))
    found = hit.groupBy("key").agg(F.min(F.struct("first", "stop", "server")).alias("_r")).select(F.col("key").alias("_key"), F.col("_r.server").alias("_server"))
    out = keys.join(found, F.col("key") == F.col("_key"), "left")
    return out.select(*keys.columns, F.coalesce("_server", F.lit(last["server"] if last else None)).cast("int").alias("server"))


def slice_batches(sliced: DataFrame, position: str = "pos", val: str | None = None, size: int = 100_000, width: int = RANGE) -> DataFrame:
    """(server, batch, first, keys[, vals]): each server's keys, with val also their values, in request order; servers by first appearance.

    A batch holds at most size keys, however many a server gets.
    """
    d = running_sums(sliced, position, {"_n": F.lit(1)}, by=("server",), width=width).withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int"))
    packed = F.array_sort(F.collect_list(F.struct(position, "key", *([val] if val else []))))
    out = d.groupBy("server", "batch").agg(F.min(position).alias("first"), packed.alias("p"))
    values = [F.col(f"p.{val}").alias("vals")] if val else []
    return out.select("server", "batch", "first", F.col("p.key").alias("keys"), *values).orderBy("first")


def node_of_thread(tid: Column) -> Column:
    return F.floor(tid / NODE).cast("long")


def server_threads(nodes: DataFrame, per_node: int) -> DataFrame:
    """(node, tid) of the servers on each node (column node); at most HELPERS - 1 a node."""
    if not 1 <= per_node < HELPERS:
        raise ValueError("a node has 1 to 49 server threads")
    return nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("i")).select("node", (F.col("node") * NODE + F.col("i")).alias("tid"))


def helper_threads(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", (F.col("node") * NODE + HELPERS).alias("tid"))


def allocate_workers(spec: DataFrame) -> DataFrame:
    """(node, num) -> (worker_id, node, tid): workers numbered on by node, threads within a node from WORKERS on.

    Only the spec (a row a node) is ordered as a whole.
    """
    upto = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    s = spec.filter("num > 0").withColumn("base", F.coalesce(F.sum("num").over(upto), F.lit(0)))
    s = s.select("node", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num").cast("long") - 1)).alias("i"))
    return s.select((F.col("base") + F.col("i")).alias("worker_id"), "node", (F.col("node") * NODE + WORKERS + F.col("i")).alias("tid"))


def deallocate_workers(workers: DataFrame, gone: DataFrame) -> DataFrame:
    """workers without the (node, tid) in gone; unknown ones are ignored."""
    return workers.join(gone.select("node", "tid"), ["node", "tid"], "left_anti")


def allocate_worker(nodes: DataFrame, workers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tid): the thread that each wanted node's next worker gets, WORKERS plus its number of workers; -1 for an unknown or a full node."""
    n = workers.groupBy("node").agg(F.count("*").alias("n"))
    w = wanted.select("node").distinct().join(n, "node", "left").join(nodes.select("node", F.lit(True).alias("known")), "node", "left")
    n = F.coalesce("n", F.lit(0))
    return w.select("node", F.when(F.col("known") & (n + WORKERS < NODE), F.col("node") * NODE + WORKERS + n).otherwise(-1).cast("long").alias("tid"))


def threads_of(threads: DataFrame, node: int) -> DataFrame:
    """The threads (of any kind) of one node; none for an unknown node."""
    return threads.filter(F.col("node") == node).select("tid")
