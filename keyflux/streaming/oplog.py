"""Keyed tables fed by a stream of operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import OP_LOG


def read_log(spark, path: str) -> DataFrame:
    """A stream of parquet files of operations."""
    return spark.readStream.schema(OP_LOG).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """(key, val): the state after all Adds so far; for output modes update and complete."""
    return log.filter("flag = 'Add'").groupBy("key").agg(F.max_by("val", "seq").alias("val"))


def asp_answers(log: DataFrame) -> DataFrame:
    """(seq, tid, key, val): every Get with the last Add of its key before it.

    Keys are states of their own: the last (seq, val).  Within a micro-batch
    operations are taken by seq; across batches by arrival, as a server would.
    """

    def answer(key, frames, state: GroupState):
        seq, val = state.get if state.exists else (-1, 0.0)
        ops = pd.concat(list(frames)).sort_values("seq")
        added = ops["flag"] == "Add"
        now = ops["val"].where(added).ffill().fillna(val)  # the last Add up to each operation
        if added.any():
            seq, val = ops["seq"][added].iloc[-1], ops["val"][added].iloc[-1]
        state.update((int(seq), float(val)))
        yield ops[["seq", "tid"]].assign(key=key[0], val=now)[~added].astype({"seq": "int64", "tid": "int64", "key": "int64", "val": "float64"})

    ops = log.filter("flag in ('Add', 'Get')").select("seq", "tid", "flag", "key", "val")
    return ops.groupBy("key").applyInPandasWithState(answer, "seq long, tid long, key long, val double", "seq long, val double", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(log: DataFrame, path: str, checkpoint: str, compact: int = 16):
    """Keep the table (key, seq, val) in path up to date; returns the writer to start. read_table() reads it.

    A micro-batch writes its own keys alone, as path/d<batch>.  Every `compact`
    batches all parts so far become path/t<batch>, after which those are
    deleted.  A batch that is run again overwrites its part.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.filter("flag = 'Add'").select("key", "seq", "val")
        _last(new).write.mode("overwrite").parquet(f"{path}/d{number}")
        if number % compact == compact - 1:
            parts = _parts(spark, path, number)
            _last(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{path}/t{number}")
            fs, _ = _folder(spark, path)
            for p in parts:
                if p != f"{path}/t{number}":
                    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _last(writes: DataFrame) -> DataFrame:
    return writes.groupBy("key").agg(F.max(F.struct("seq", "val")).alias("s")).select("key", "s.seq", "s.val")


def _folder(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _parts(spark, path: str, upto: int | None = None) -> list[str]:
    """The finished parts of the table: the last whole one before batch upto, and the batches after it."""
    fs, at = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    whole = max((int(n[1:]) for n in names if n[0] == "t" and (upto is None or int(n[1:]) < upto)), default=-1)
    later = sorted(int(n[1:]) for n in names if n[0] == "d" and int(n[1:]) > whole and (upto is None or int(n[1:]) <= upto))
    return ([f"{path}/t{whole}"] if whole >= 0 else []) + [f"{path}/d{n}" for n in later]


def read_table(spark, path: str) -> DataFrame:
    """(key, seq, val): the table that upsert_batches keeps."""
    return _last(spark.read.schema("key long, seq long, val double").parquet(*_parts(spark, path)))
