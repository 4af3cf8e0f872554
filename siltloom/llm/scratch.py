"""Tables that cut lineage: written to a folder that driver and executors share, then read back.

The folder is the one in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
folder under /tmp/checkpoints and a cluster the warehouse, which its machines share.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What Spark's writers leave last.
SUCCESS = "_SUCCESS"
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "local").startswith("local") and "cluster" not in spark.conf.get("spark.master", ""):
        return "file:///tmp/checkpoints/siltloom"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_siltloom_scratch"


def under(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system that Spark reads, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or ())


class Scratch:
    """Intermediate Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.made: list[DataFrame] = []

    @contextmanager
    def swept(self):
        """Within, the shuffle files of a query go as soon as it has ended, not when the driver collects garbage."""
        old = self.spark.conf.get(SWEEP, None)
        self.spark.conf.set(SWEEP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SWEEP, old) if old is not None else self.spark.conf.unset(SWEEP)

    @contextmanager
    def batches(self, rows: int):
        """Within, an Arrow batch holds at most so many rows; Spark also bounds its bytes."""
        old = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(rows))
        try:
            yield
        finally:
            self.spark.conf.set(BATCH, old)

    @contextmanager
    def dropping(self, *names: str):
        """Afterwards, with an error or without, the tables cut here but those kept are deleted, and the named ones of the catalog."""
        try:
            yield
        finally:
            self.drop(*self.made)
            self.made.clear()
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` to the shared folder and return a reader of what was written."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        with self.swept():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siltloom_path = path
        self.made.append(out)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written like the others, but left for whoever reads the operator's result."""
        out = self.cut(df)
        self.made.pop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_siltloom_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
