"""Keys that occur more than once: the latest row, all members, later copies, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in ``order``, which ends in a tie-breaker."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def group_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once; nulls are equal to each other."""
    return df.withColumn("group_size", F.count("*").over(W.partitionBy(*keys))).filter("group_size > 1")


def later_copies(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every row of a key but the first in ``order``."""
    return df.withColumn("copy_number", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("copy_number > 1")


def changed_versions(df: DataFrame, key: str, watched: Sequence[str]) -> DataFrame:
    """Keys with different values in a watched column; null is a value of its own."""
    n = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in watched]
    return df.groupBy(key).agg(*n).filter(" or ".join(f"n_{c} > 1" for c in watched))


def values_per_key(df: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """Distinct values of each key, in order, joined by commas."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias(output))


def with_version_kinds(df: DataFrame, keys: Sequence[str], row: str, order: Sequence[Column], failed: Column, day: Column, description: Column) -> DataFrame:
    """``df`` with the kind of each row's group in ``version_kind``, empty where its keys do not repeat, and whether it is current.

    A: an earlier one failed.  B: all of one day and all described differently
    (separate matters, all current).  C: all of one day.  D: anything else.
    Null keys make no group; ``_apart`` parts their rows, by ``row``.  All
    windows have one partitioning, and the rows pass once.
    """
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    df = df.withColumn("_apart", F.when(~named, F.coalesce(F.col(row).cast("string"), F.lit(""))))
    by_key = W.partitionBy(*keys, "_apart")
    in_order = by_key.orderBy(*order)
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    repeated = (F.col("_n") > 1) & F.col("_apart").isNull()
    numbered = df.withColumns({"_n": F.count("*").over(by_key), "_at": F.row_number().over(in_order), "_day": day, "_description": description, "_failed": F.coalesce(failed, F.lit(False))})
    seen = numbered.withColumns(
        {
            "_earlier_failed": F.max(F.col("_failed") & (F.col("_at") < F.col("_n"))).over(whole),
            # rows without a group add nothing to the sets
            "_days": F.size(F.collect_set(F.when(repeated, F.col("_day"))).over(by_key)),
            "_descriptions": F.size(F.collect_set(F.when(repeated, F.col("_description"))).over(by_key)),
        }
    )
    one_day = F.col("_days") == 1
    kind = F.when(~repeated, "").when(F.col("_earlier_failed"), "A").when(one_day & (F.col("_descriptions") == F.col("_n")), "B").when(one_day, "C").otherwise("D")
    out = seen.withColumn("version_kind", kind).withColumn("is_current", F.col("version_kind").isin("", "B") | (F.col("_at") == F.col("_n")))
    return out.drop("_n", "_at", "_day", "_description", "_failed", "_earlier_failed", "_days", "_descriptions")


def version_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column, day: Column, description: Column) -> DataFrame:
    """Rows of repeated keys with the kind of their group and whether they are current, as ``with_version_kinds`` has them."""
    named = df.filter(" and ".join(f"{k} is not null" for k in keys))
    return with_version_kinds(named, keys, keys[0], order, failed, day, description).filter("version_kind <> ''").drop("_apart")
