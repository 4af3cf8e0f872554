"""Sessions, and what a session needs to run this package on its executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: what a Python worker holds at once, however large the input is.
BATCH = {"maxRecordsPerBatch": 512, "maxBytesPerBatch": 1 << 22}


def build(app: str = "siltloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, and whatever ``conf`` adds."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH; what the session has set lower stays."""
    for name, most in BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        set_to = spark.conf.get(key)
        if set_to.isdigit() and 0 < int(set_to) <= most:
            continue
        spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound what they hold.

    Needed where workers don't share the driver's import path.
    """
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "siltloom"), "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return "file:///tmp/checkpoints/siltloom"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siltloom_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)  # only what is there is deleted on exit
    fs.deleteOnExit(p)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, absolute."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, or to ``path``, and read again, so that its lineage ends there."""
    spark = df.sparkSession
    path = path or f"{scratch(spark, 'core')}/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
