"""Session helpers: a tuned local session, shipping of the package, shared scratch space."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local[N] session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="quire-ship-")  # read by the driver's file server only
        target = os.path.join(folder, "quire_package.zip")
        with zipfile.ZipFile(target, "w") as z:
            for top, _, names in os.walk(_PACKAGE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.join("quire", os.path.relpath(full, _PACKAGE)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


#: Rows and bytes of one Arrow batch; a batch of long texts or whole files is cut by the bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a worker's memory depends on neither partition nor row lengths.

    The one place where the session's settings are changed: they are read when a plan runs, long after it is made, so
    they can't be given back; stricter ones of the caller stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        given = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
        if given is None or not 0 < int(given[1]) << 10 * " kmg".index(given[2] or " ") <= most:
            spark.conf.set(key, str(most))
    return spark


def open_fs(path: str):
    """File system and path of a shared folder's URI, for workers that write files of their own."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in spark.checkpoint.dir; only where that is unset (tests, local mode) a folder of
    this machine is chosen."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        checkpoint = spark.sparkContext.getCheckpointDir()
        if checkpoint:
            return os.path.dirname(checkpoint.rstrip("/"))
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quire-scratch")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/quire/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one run in the shared folder: kept under names, dropped when their readers are done."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, scratch_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; shuffle files of jobs that have ended go once the driver's references to them are collected."""
        df.write.parquet(f"{self.folder}/{name}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, f"{self.folder}/{name}")


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table whose rows nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
