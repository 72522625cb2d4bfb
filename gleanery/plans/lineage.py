"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Spark's setting by which the shuffle files of a job go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return f"file://{_own[key]}"


class Scratch:
    """Tables of one computation, each written once and read again; `drop` gives their space back early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        """A new place in the shared folder."""
        self.n += 1
        return f"{self.base}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        """df, read from a table. Its shuffle files go with the job: else they stay until the driver happens to collect its garbage, which is seldom as tables grow."""
        path, before = self.path(), self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
