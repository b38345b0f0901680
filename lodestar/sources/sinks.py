"""Batch tables kept by month: processes, validated rows, monthly news.

A write replaces the months that its rows have and leaves all others.  Rows
must have the table's schema: columns may come in any order, but none may be
missing, and types must be the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestar.schemas import NEWS, PROCESS
from lodestar.sources.tables import files_of

#: The column by which tables are kept, beside their own.
MONTH = "month_part"
NO_MONTH = "none"


class WrongSchema(ValueError):
    """Rows that do not fit the table they are written to."""


def fitted(df: DataFrame, schema: T.StructType, more: bool = False) -> DataFrame:
    """``df`` with the schema's columns in its order; ``more`` lets further columns follow."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    odd = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    extra = [] if more else [n for n in have if n not in schema.names]
    if missing or odd or extra:
        raise WrongSchema("; ".join([*(f"{n} is missing" for n in missing), *odd, *(f"{n} is not in the table" for n in extra)]))
    return df.select(*schema.names, *(n for n in df.columns if n not in schema.names))


def write_months(df: DataFrame, path: str, month: Column) -> None:
    """Replaces the months (``YYYY-MM``) that ``df`` has; rows without one are kept as a month of their own.

    Rows of a month meet before they are written, and large months are split.
    A table that is there must have the same columns.
    """
    spark = df.sparkSession
    where, files = files_of(spark, path)
    if files.exists(where) and any(f.getPath().getName().startswith(f"{MONTH}=") for f in files.listStatus(where)):
        old = spark.read.parquet(path).drop(MONTH).schema
        fitted(df, T.StructType([T.StructField(f.name, f.dataType) for f in old.fields]))
        df = df.select(*old.names)
    parts = df.withColumn(MONTH, F.coalesce(F.when(month.rlike(r"^\d{4}-\d{2}$"), month), F.lit(NO_MONTH)))
    dealt = spark.sql(f"SELECT /*+ REBALANCE({MONTH}) */ * FROM {{rows}}", rows=parts)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The table, or some of its months; only their folders are read."""
    table = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return (table if months is None else table.filter(F.col(MONTH).isin(*months))).drop(MONTH)


def write_processes(df: DataFrame, path: str) -> None:
    """One flat row per process, by the month of its file."""
    write_months(fitted(df, T.StructType.fromDDL(PROCESS)), path, F.col("file_month"))


def write_validated(df: DataFrame, path: str) -> None:
    """Processes with the columns that validation adds, by month."""
    write_months(fitted(df, T.StructType.fromDDL(PROCESS), more=True), path, F.col("file_month"))


def write_news(df: DataFrame, path: str) -> None:
    """The API's rows by month of publication."""
    write_months(fitted(df, T.StructType.fromDDL(NEWS), more=True), path, F.substring("published_at", 1, 7))
