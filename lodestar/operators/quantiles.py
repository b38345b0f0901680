"""Exact order statistics per group by counting, without a list or a sort of a group's values.

A value is a whole number or is counted in its own cell.  Totals per cell come
first, running totals over the cells of a group say in which cell a place
lies, and only that cell's distinct values are looked at.  What stands in a
window is cells of a group, or distinct values of one cell, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Distinct values of a group that share a cell, for values spread evenly.
CELLS = 4096


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., v, n): how often each value is there; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("v")).agg(F.count("*").alias("n"))


def at_places(df: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by..., name, value): the values at the given places from 1 in each group's order.

    ``places`` are columns of ``size``, the group's number of values; a place
    outside 1 to ``size`` is moved to the nearer end.
    """
    counts = value_counts(df, by, value)
    span = counts.groupBy(*by).agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.sum("n").alias("size"))
    width = F.greatest((F.col("_high") - F.col("_low")) / CELLS, F.lit(1e-300))
    cell = F.least(F.floor((F.col("v") - F.col("_low")) / width), F.lit(CELLS - 1)).cast("int")
    keyed = same_keys(counts, span, by).withColumn("_cell", cell)
    cells = keyed.groupBy(*by, "_cell").agg(F.sum("n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before)
    wanted = span.select(*by, F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(k), F.least(F.greatest(p.cast("long"), F.lit(1)), F.col("size"))) for k, p in places.items())))).alias("name", "_place"))
    hit = same_keys(cells, wanted, by).filter((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + F.col("_in")))
    inside = same_keys(keyed, hit.select(*by, "_cell", "name", "_place", "_before"), [*by, "_cell"])
    upto = F.col("_before") + F.sum("n").over(W.partitionBy(*by, "_cell", "name").orderBy("v"))
    return inside.withColumn("_upto", upto).filter((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("n"))).select(*by, "name", F.col("v").alias("value"))


def same_keys(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of equal ``by``, null keys included."""
    if not by:
        return a.crossJoin(b)
    right = b.select(*(F.col(c).alias(f"_b_{c}") for c in by), *(c for c in b.columns if c not in by))
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    for c in on[1:]:
        on[0] = on[0] & c
    return a.join(right, on[0]).drop(*(f"_b_{c}" for c in by))


def described(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(by..., n, least, median, most, and a column for each of ``shares``).

    Shares are exclusive quantiles: the value at place ``share`` (n + 1),
    interpolated; past the ends by the last two values; of one value, itself.
    """
    shares = shares or {}
    size = F.col("size")
    lower = {k: F.least(F.greatest(F.floor(share * (size + 1)), F.lit(1)), F.greatest(size - 1, F.lit(1))) for k, share in shares.items()}
    places = {"_m0": F.floor((size + 1) / 2), "_m1": F.floor(size / 2) + 1}
    for k, place in lower.items():
        places |= {f"{k}0": place, f"{k}1": place + 1}
    found = at_places(df, by, value, places)
    sizes = value_counts(df, by, value).groupBy(*by).agg(F.sum("n").alias("size"), F.min("v").alias("least"), F.max("v").alias("most"))
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in places))
    out = [size.alias("n"), "least", ((F.col("_m0") + F.col("_m1")) / 2).alias("median"), "most"]
    for k, share in shares.items():
        step = share * (size + 1) - lower[k]
        out.append(F.when(size < 2, F.col(f"{k}0")).otherwise(F.col(f"{k}0") * (1 - step) + F.col(f"{k}1") * step).alias(k))
    return same_keys(sizes, wide, by).select(*by, *out)


def exclusive(df: DataFrame, by: Sequence[str], value: str, share: float, output: str) -> DataFrame:
    """(by..., output): one exclusive quantile of each group."""
    return described(df, by, value, {output: share}).select(*by, output)
