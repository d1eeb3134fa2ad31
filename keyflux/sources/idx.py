"""IDX image and label files (big-endian header; magic 0x803 and 0x801)."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import binarize, normalize, one_hot

# Fixed values of the format.
IMAGES, LABELS = 0x803, 0x801
FILES = {"train": ("train-images-idx3-ubyte", "train-labels-idx1-ubyte"), "test": ("t10k-images-idx3-ubyte", "t10k-labels-idx1-ubyte")}


def decode(content: bytes, magic: int) -> np.ndarray:
    """The file's values, a row per item; raises where the header or the size is wrong."""
    found, n = struct.unpack_from(">II", content)
    if found != magic:
        raise ValueError(f"magic number {found:#x} instead of {magic:#x}")
    dims = struct.unpack_from(">II", content, 8) if magic == IMAGES else ()
    each, head = int(np.prod(dims or (1,))), 8 + 4 * len(dims)
    if len(content) < head + n * each:
        raise ValueError("the file is shorter than its header says")
    return np.frombuffer(content, np.uint8, n * each, head).reshape(n, each)


def _read(spark: SparkSession, path: str, magic: int, column: str, kind: str, start: int, limit: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = decode(content, magic)[start : start + limit if limit else None]
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096].astype(np.int16)
                    idx = pa.array(np.arange(start + a, start + a + len(part), dtype=np.int32))
                    values = pa.array(list(part), pa.list_(pa.int16())) if magic == IMAGES else pa.array(part[:, 0], pa.int16())
                    yield pa.RecordBatch.from_arrays([idx, values], names=["idx", column])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, f"idx int, {column} {kind}")


def read_images(spark: SparkSession, path: str, start: int = 0, limit: int = 0, function: Callable | None = None) -> DataFrame:
    """(idx, pixels): all images, or `limit` from `start` on; function maps the pixels column."""
    df = _read(spark, path, IMAGES, "pixels", "array<smallint>", start, limit)
    return df.withColumn("pixels", function(F.col("pixels"))) if function else df


def read_labels(spark: SparkSession, path: str, start: int = 0, limit: int = 0, categorical: bool = False) -> DataFrame:
    """(idx, label), and with `categorical` the label's one-hot array."""
    df = _read(spark, path, LABELS, "label", "smallint", start, limit)
    return df.withColumn("hot", one_hot(F.col("label"))) if categorical else df


def read_dataset(spark: SparkSession, folder: str, train_limit: int = 0, test_limit: int = 0) -> DataFrame:
    """(split, idx, pixels, label) of the four files in folder."""
    parts = []
    for split, limit in (("train", train_limit), ("test", test_limit)):
        images, labels = FILES[split]
        both = read_images(spark, f"{folder}/{images}", limit=limit).join(read_labels(spark, f"{folder}/{labels}", limit=limit), "idx")
        parts.append(both.select(F.lit(split).alias("split"), "idx", "pixels", "label"))
    return parts[0].unionByName(parts[1])


def binarized(images: DataFrame, threshold: float = 30.0) -> DataFrame:
    return images.withColumn("pixels", binarize(F.col("pixels"), threshold))


def normalized(images: DataFrame) -> DataFrame:
    return images.withColumn("pixels", normalize(F.col("pixels")))


def _write(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """A file of the bytes given, by Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in parts:
            out.write(part)
    finally:
        out.close()


def _rows(df: DataFrame, size: int = 10_000) -> Iterator[np.ndarray]:
    """Values of the one column of df, in its order, some rows at a time: an IDX file is one file, so one machine writes it."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row[0])
        if len(held) == size:
            yield np.asarray(held, np.uint8)
            held = []
    if held:
        yield np.asarray(held, np.uint8)


def write_images(pixels: DataFrame, path: str, height: int, width: int) -> None:
    """One IDX file of the images (arrays of height * width numbers below 256) in the order of pixels."""
    head = struct.pack(">IIII", IMAGES, pixels.count(), height, width)
    _write(pixels.sparkSession, path, chain([head], (a.tobytes() for a in _rows(pixels))))


def write_labels(labels: DataFrame, path: str) -> None:
    head = struct.pack(">II", LABELS, labels.count())
    _write(labels.sparkSession, path, chain([head], (a.tobytes() for a in _rows(labels))))
