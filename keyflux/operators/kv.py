"""Keyed tables: puts where the last writer wins, batched lookups with a zero default, append logs, a table registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import APPEND_LOG, KV_STATE
from ..session import discard, saved
from .slices import jump_slice, range_slice

#: A table is broadcast in a join up to so many rows (of 16 bytes).
BROADCAST_ROWS = 1_000_000


def put(writes: DataFrame, order: list[str] | str = "seq") -> DataFrame:
    """(key, val) after all writes (key, val, order...): per key the last by order. Partial results are combined before the exchange."""
    order = [order] if isinstance(order, str) else order
    return writes.groupBy("key").agg(F.max_by("val", F.struct(*order)).alias("val"))


def upsert(state: DataFrame, writes: DataFrame, order: list[str] | str = "seq") -> DataFrame:
    """state with the writes applied; keys that aren't written keep their value."""
    new = put(writes, order).select("key", F.col("val").alias("_new"), F.lit(True).alias("_hit"))
    return state.join(new, "key", "full").select("key", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("val")).alias("val"))


def _small(df: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def get(state: DataFrame, keys: DataFrame, rows: int | None = None) -> DataFrame:
    """(key, val) of the distinct keys, 0 where state has none. rows: the table's size, if known; a small one is broadcast."""
    return keys.select("key").distinct().join(_small(state, rows), "key", "left").select("key", F.coalesce("val", F.lit(0.0)).alias("val"))


def get_sorted(state: DataFrame, keys: DataFrame) -> DataFrame:
    """As a client sees it: each key once, by key."""
    return get(state, keys).orderBy("key")


def server_get(state: DataFrame, keys: DataFrame, position: str = "pos") -> DataFrame:
    """As a server replies: a row per requested key, repeats included, with the request's position."""
    return keys.select(position, "key").join(state, "key", "left").select(position, "key", F.coalesce("val", F.lit(0.0)).alias("val"))


def append(log: DataFrame, writes: DataFrame) -> DataFrame:
    return log.select("seq", "key", "val").unionByName(writes.select("seq", "key", "val"))


def append_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookup in an append log: the last matching entry, 0 without one. An equi-join, whatever the log's length."""
    hits = log.join(keys.select("key").distinct(), "key", "left_semi")
    return get(put(hits), keys)


def missing(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requested keys that the cache doesn't hold."""
    return keys.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def checked(keys: list[int], vals: list[float]) -> list[tuple[int, float]]:
    """Keys and values of a client's batch as pairs; raises where the numbers differ."""
    if len(keys) != len(vals):
        raise ValueError(f"{len(keys)} keys and {len(vals)} values")
    return list(zip(keys, map(float, vals)))


class MapStorage:
    """A value a key; the last write wins."""

    schema = KV_STATE

    def add(self, state: DataFrame, writes: DataFrame) -> DataFrame:
        return upsert(state, writes)

    def get(self, state: DataFrame, keys: DataFrame) -> DataFrame:
        return get(state, keys)

    def state(self, state: DataFrame) -> DataFrame:
        """(key, val) of all keys."""
        return state


class AppendStorage(MapStorage):
    """All writes are kept; a lookup takes the last."""

    schema = APPEND_LOG

    def add(self, state: DataFrame, writes: DataFrame) -> DataFrame:
        return append(state, writes)

    def get(self, state: DataFrame, keys: DataFrame) -> DataFrame:
        return append_get(state, keys)

    def state(self, state: DataFrame) -> DataFrame:
        return put(state)


@dataclass(frozen=True)
class Ranges:
    """Keys to servers by half-open ranges; those outside of all to the last."""

    ranges: tuple[tuple[int, int], ...]

    def server(self, keys: DataFrame) -> DataFrame:
        return range_slice(keys, list(self.ranges))


@dataclass(frozen=True)
class Jump:
    """Keys to so many servers by jump consistent hashing."""

    servers: int = 1

    def server(self, keys: DataFrame) -> DataFrame:
        return jump_slice(keys, self.servers)


STORAGES = {"map": MapStorage, "append": AppendStorage}
#: A table is written, which cuts its lineage, after so many batches of writes.
WRITE_EVERY = 4


@dataclass
class Store:
    """Registry of tables by number: each with a storage, a partitioner, a consistency model and its workers' clocks.

    A storage is "map", "append" or any object with MapStorage's methods; a
    partitioner any object with Jump's.
    """

    spark: SparkSession
    tables: dict[int, DataFrame] = field(default_factory=dict)
    kinds: dict[int, MapStorage] = field(default_factory=dict)
    partitioners: dict[int, Jump | Ranges] = field(default_factory=dict)
    models: dict[int, tuple[str, int]] = field(default_factory=dict)
    clocks: dict[int, dict[int, int]] = field(default_factory=dict)
    _seq: int = 0
    _adds: dict[int, int] = field(default_factory=dict)
    _kept: dict[int, DataFrame] = field(default_factory=dict)

    def create(self, storage: str | MapStorage = "map", model: str = "bsp", staleness: int = 0, partitioner: Jump | Ranges | None = None) -> int:
        if isinstance(storage, str) and storage not in STORAGES or model not in ("asp", "bsp", "ssp"):
            raise ValueError(f"no such storage or model: {storage}, {model}")
        number = len(self.tables)
        self.kinds[number] = STORAGES[storage]() if isinstance(storage, str) else storage
        self.tables[number] = self.spark.createDataFrame([], self.kinds[number].schema)
        self.partitioners[number] = partitioner or Jump()
        self.models[number], self.clocks[number] = (model, staleness), {}
        return number

    def reset_workers(self, number: int, tids: list[int]) -> None:
        self.clocks[number] = {t: 0 for t in tids}

    def add(self, number: int, keys: list[int], vals: list[float]) -> None:
        rows = [(self._seq + i, k, v) for i, (k, v) in enumerate(checked(keys, vals))]
        self._seq += len(rows)
        self.add_rows(number, self.spark.createDataFrame(rows, APPEND_LOG))

    def add_rows(self, number: int, writes: DataFrame) -> None:
        """Writes (seq, key, val) of any size."""
        now = self.kinds[number].add(self.tables[number], writes)
        self._adds[number] = self._adds.get(number, 0) + 1
        if self._adds[number] % WRITE_EVERY == 0:
            now = saved(now, f"table-{number}")
            discard(self._kept.get(number))
            self._kept[number] = now
        self.tables[number] = now

    def add_ordered(self, number: int, writes: DataFrame) -> None:
        """Writes (seq, key, val) whose seq is any order of their own; they come after all earlier writes."""
        last = writes.groupBy("key").agg(F.max_by("val", "seq").alias("val")).withColumn("seq", F.lit(self._seq).cast("long"))
        self._seq += 1
        self.add_rows(number, last.select("seq", "key", "val"))

    def get(self, number: int, keys: list[int]) -> DataFrame:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key BIGINT")
        return self.kinds[number].get(self.tables[number], wanted).orderBy("key")

    def state(self, number: int) -> DataFrame:
        """(key, val) of a whole table."""
        return self.kinds[number].state(self.tables[number])

    def slices(self, number: int) -> DataFrame:
        """(key, val, server): which server has each key."""
        return self.partitioners[number].server(self.state(number))

    def clock(self, number: int, tid: int) -> int:
        """Advance a worker; the new least clock if it moved, else -1."""
        clocks = self.clocks[number]
        before = min(clocks.values())
        clocks[tid] += 1
        now = min(clocks.values())
        return now if now > before else -1
