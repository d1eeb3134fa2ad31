"""Session settings and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "keyflux", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under: ANSI on, UTC, adaptive execution on."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows of an Arrow batch: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: Python functions are found there by name.

    Arrow batches are set to BATCH_ROWS rows where the session has Spark's default.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_keyflux_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="keyflux-"), "keyflux.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(here)))
    sc.addPyFile(path)
    sc._keyflux_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset a local master gets a temporary one; on a cluster each
    machine would have its own, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keyflux-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors. discard() deletes it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/keyflux/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyflux_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that saved() wrote; nothing may read it later. Other tables are left alone."""
    path = getattr(df, "_keyflux_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
