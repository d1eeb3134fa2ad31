"""Text files and lines: block scans, samples, ratings, machine files, URLs, statistics logs."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """(value): the lines of the files in path, in parallel by block.

    Lines end at "\\n" alone (a "\\r" stays); a last line without one counts;
    folders below path are not read.
    """
    if block_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    return spark.read.option("lineSep", "\n").text(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, blocks): the files directly in path and how many blocks a scan deals."""
    block = F.lit(int(spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf.get().filesMaxPartitionBytes()))
    return spark.read.format("binaryFile").load(path).select("path", "length", F.ceil(F.col("length") / block).cast("int").alias("blocks"))


def load(spark: SparkSession, path: str, parse, block_bytes: int | None = None) -> DataFrame:
    """Samples of the text files in path: a parser of this module, applied where the lines are read."""
    return parse(read_lines(spark, path, block_bytes))


def batches(df: DataFrame, size: int):
    """Lists of `size` rows on the driver, the last one shorter; the next partition is fetched while one is consumed."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def prefetched(items: Iterable, depth: int = 2) -> Iterator:
    """items, the next `depth` of them fetched by a thread while one is worked on; its errors are raised here."""
    ready: queue.Queue = queue.Queue(depth)
    gone = threading.Event()

    def put(item) -> bool:
        while not gone.is_set():
            try:
                ready.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def produce():
        try:
            for item in items:
                if not put((item, None)):
                    return
            put((None, StopIteration()))
        except BaseException as error:  # noqa: BLE001 - handed to the consumer
            put((None, error))

    threading.Thread(target=produce, daemon=True).start()
    try:
        while True:
            item, error = ready.get()
            if isinstance(error, StopIteration):
                return
            if error:
                raise error
            yield item
    finally:
        gone.set()


def map_batches(df: DataFrame, function: Callable, schema: str, size: int = 1000, depth: int = 2) -> DataFrame:
    """function over pandas frames of at most `size` rows, on the executors; each worker cuts and converts frames ahead of their use."""

    def work(frames):
        parts = (f.iloc[a : a + size] for f in frames for a in range(0, len(f), size))
        for part in prefetched(parts, depth):
            yield function(part)

    return df.mapInPandas(work, schema)


def split_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., line_no, line): the lines of a text column; an empty end after the last "\\n" is no line."""
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(parts).alias("line_no", "line"))


def truncated_int(s: Column) -> Column:
    """The number a text begins with, towards zero; 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def leading_double(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def parse_libsvm(lines: DataFrame, value: str = "value", sample_id: str | None = None) -> DataFrame:
    """Lines "label idx:x ..." as (sample_id, label, features map<int,double>). Indices stay as written; blank lines are left out."""
    df = lines.filter(F.trim(value) != "")
    parts = F.filter(F.split(F.trim(value), r"\s+"), lambda s: s != "")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.split(s, ":"))
    features = F.map_from_entries(F.transform(pairs, lambda p: F.struct(truncated_int(p[0]).alias("idx"), leading_double(p[1]).alias("x"))))
    sid = F.col(sample_id) if sample_id else F.monotonically_increasing_id()
    return df.select(sid.cast("long").alias("sample_id"), truncated_int(F.element_at(parts, 1)).alias("label"), features.alias("features"))


def long_samples(samples: DataFrame) -> DataFrame:
    """(sample_id, label, idx, x), a row per stored feature."""
    return samples.select("sample_id", "label", F.explode("features").alias("idx", "x"))


def render_libsvm(samples: DataFrame) -> DataFrame:
    """(sample_id, value): samples as lines, features by index."""
    entry = F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return samples.select("sample_id", F.concat_ws(" ", F.col("label").cast("string"), F.concat_ws(" ", entry)).alias("value"))


def parse_ratings(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines "user\\titem\\trating" as (user, item, rating), other columns kept."""
    p = F.split(F.col(value), "\t")
    return lines.select(*[c for c in lines.columns if c != value], truncated_int(p[0]).cast("long").alias("user"), truncated_int(p[1]).cast("long").alias("item"), truncated_int(p[2]).alias("rating"))


def parse_nodes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Machine-file lines "id:host:port" as (id, hostname, port); lines that begin with "#" and blank ones are left out."""
    p = F.split(F.trim(value), ":")
    return lines.filter((F.trim(value) != "") & ~F.trim(value).startswith("#")).select(p[0].cast("long").alias("id"), p[1].alias("hostname"), p[2].cast("int").alias("port"))


#: Parts of a URL by group: scheme, user, password, host, port, path, query, fragment. Schemes hold letters, "+", "-" and
#: "."; "//" is needed; an "@" before the first "/" ends user and password; a host in brackets ends at "]"; a port runs to
#: the next "/"; "?" and "#" count in the path alone. No part is tried twice.
URL = r"(?s)\A([A-Za-z+.-]*+)://(?:(?=[^/@]*+@)([^:@/]*+)(?::([^@/]*+))?+@)?+(\[[^\]]*+(?:\]|\z)|(?!\[)[^:/]*+)(?::([^/]*+))?+(?:/([^?#]*+)(?:\?([^#]*+))?+(?:#(.*+))?+)?+\z"


def parse_url(df: DataFrame, url: str, keep: list[str], default_host: str = "localhost", default_port: int = 9000) -> DataFrame:
    """(keep..., valid, scheme, user, password, host, port, path, query, fragment).

    Absent parts are empty, as are all of an invalid URL; an empty host and port
    have defaults; a port is the number it begins with, null if it begins with
    none.
    """
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL, i), F.lit(""))
    valid = F.coalesce(F.col(url).rlike(URL), F.lit(False))
    host = F.when(part(4) == "", default_host).otherwise(part(4))
    port = F.when(part(5) == "", default_port).otherwise(F.regexp_extract(part(5), r"^\s*([+-]?\d+)", 1).try_cast("int"))
    return df.select(*keep, valid.alias("valid"), F.lower(part(1)).alias("scheme"), part(2).alias("user"), part(3).alias("password"), host.alias("host"), port.alias("port"), part(6).alias("path"), part(7).alias("query"), part(8).alias("fragment"))


#: The tags of statistics lines.
STAT_TAGS = ("TIME", "WORK", "WAIT", "PROC", "ITER", "TOTL", "ACCU")
STAT = r"\[STAT_([A-Z]+)\]\s*([-0-9.,eE+]+)"


def stat_lines(stats: DataFrame) -> DataFrame:
    """(value): statistics rows as log lines."""
    return stats.select(F.concat(F.lit("I0101 00:00:00 node ] [STAT_"), F.col("stat_type"), F.lit("] "), F.concat_ws(",", F.col("iter").cast("string"), F.col("tid").cast("string"), F.col("value").cast("string"))).alias("value"))


def parse_stats(lines: DataFrame, tags: tuple[str, ...] = STAT_TAGS, value: str = "value") -> DataFrame:
    """(stat_type, iter, tid, value) of the lines that hold one of the tags; other lines are left out."""
    fields = F.split(F.regexp_extract(F.col(value), STAT, 2), ",")
    tag = F.regexp_extract(F.col(value), STAT, 1)
    return lines.filter(F.col(value).contains("[STAT_")).select(tag.alias("stat_type"), fields[0].cast("int").alias("iter"), fields[1].cast("long").alias("tid"), fields[2].cast("double").alias("value")).filter(F.col("stat_type").isin(*tags))


def write_stats(stats: DataFrame, path: str) -> None:
    """One CSV folder per tag, as a partition of path."""
    stats.write.mode("overwrite").partitionBy("stat_type").csv(path)


def write_totals(totals: DataFrame, path: str) -> None:
    """(iter, total) as text lines "iter total", by iteration within each file."""
    totals.sortWithinPartitions("iter").select(F.concat_ws(" ", F.col("iter").cast("string"), F.col("total").cast("string")).alias("value")).write.mode("overwrite").text(path)
