"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost
executor costs a reread and nothing else.  Without that setting a cluster uses
its warehouse folder, and a local session (a test) a folder of this process.  Tables are deleted when the
JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        # executors of a cluster see the warehouse, never this process's folders
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodestar-scratch"
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; its lineage ends at the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets go of finished shuffles."""
    jvm = None
    for table in tables:
        ref, path = _paths.pop(id(table), (lambda: None, ""))
        if ref() is table:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if jvm is not None:
        # shuffle files go when the driver collects the plans that wrote them
        jvm.System.gc()
