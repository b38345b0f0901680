"""Tables that a computation writes for itself, in a folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; without that setting a cluster uses
its warehouse, and a local session (a test) a folder of this process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestar-work"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestar-work-")
    return _own[app]


def files_of(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; what is written there goes when the session's JVM ends."""
    path = f"{work_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where, files = files_of(spark, path)
    files.deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
