"""Dashboard tables from a cube, so that no filter reads the processes again.

The cube has a row for every month, department, category and amount band that
occurs, with counts, sums and mergeable sketches, and one partition a month.
Any selection of its dimensions adds up its rows: counts and sums are exact,
numbers of different buyers come from HyperLogLog sketches (``BUYER_BITS``,
about 0.8 % off) and deciles of the amount from KLL sketches.  What a
selection cannot be told from is refused: amount limits that are no band's.

Defined results: null dimensions are values of their own; an empty selection
gives zeros, and null deciles; amounts count where they are valid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.sources.sinks import write_months

#: Lower ends of the amount bands; below the first is a band too.
BANDS = (0.0, 1e4, 1e5, 1e6, 1e7)
BUYER_BITS = 14
DIMENSIONS = ("month", "department", "category", "band")


def band(amount: Column, bands: Sequence[float] = BANDS) -> Column:
    """How many of ``bands`` an amount has reached; null without an amount."""
    reached = F.lit(0)
    for limit in bands:
        reached = reached + (amount >= limit).cast("int")
    return F.when(amount.isNotNull(), reached)


def cells(processes: DataFrame, bands: Sequence[float] = BANDS) -> DataFrame:
    """The cube of (month, department, category, amount, amount_valid, single_bid, buyer_id); a bool that is null counts as false."""
    valid = F.coalesce("amount_valid", F.lit(False))
    amount = F.when(valid, F.col("amount").cast("double"))
    return processes.groupBy("month", "department", "category", band(amount, bands).alias("band")).agg(
        F.count("*").alias("processes"),
        F.count(amount).alias("valued"),
        F.coalesce(F.sum(amount.cast("decimal(28,4)")), F.lit(0).cast("decimal(38,4)")).cast("decimal(38,4)").alias("amount"),
        F.count_if(F.coalesce("single_bid", F.lit(False))).alias("single"),
        F.hll_sketch_agg(F.coalesce("buyer_id", F.lit("")), BUYER_BITS).alias("buyers"),
        F.kll_sketch_agg_double(amount).alias("amounts"),
    )


def write_cube(processes: DataFrame, path: str, bands: Sequence[float] = BANDS) -> None:
    """Replaces the months that ``processes`` has in the cube at ``path``."""
    write_months(cells(processes, bands), path, F.col("month"))


@dataclass(frozen=True)
class Selection:
    """What a dashboard is filtered by; None selects everything."""

    months: Sequence[str] | None = None
    departments: Sequence[str] | None = None
    categories: Sequence[str] | None = None
    amount_from: float | None = None
    amount_below: float | None = None

    def where(self, bands: Sequence[float] = BANDS) -> Column:
        out = F.lit(True)
        for name, values in (("month", self.months), ("department", self.departments), ("category", self.categories)):
            if values is not None:
                out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
        for limit in (self.amount_from, self.amount_below):
            if limit is not None and limit not in bands:
                raise ValueError(f"{limit} is no limit of the cube's bands {tuple(bands)}")
        if self.amount_from is not None:
            out = out & F.coalesce(F.col("band") > list(bands).index(self.amount_from), F.lit(False))
        if self.amount_below is not None:
            out = out & F.coalesce(F.col("band") <= list(bands).index(self.amount_below), F.lit(False))
        return out


def _measures() -> list[Column]:
    zero = F.lit(0).cast("long")
    processes, valued = F.coalesce(F.sum("processes"), zero), F.coalesce(F.sum("valued"), zero)
    merged = F.kll_merge_agg_double("amounts")
    decile = lambda q: F.when(valued > 0, F.kll_sketch_get_quantile_double(merged, F.lit(q)))
    return [
        processes.alias("processes"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,2)").cast("double").alias("amount"),
        F.coalesce(F.round(F.sum("single") / F.nullif(F.sum("processes"), zero), 4), F.lit(0.0)).alias("single_rate"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("buyers")), zero).alias("buyers"),
        decile(0.5).alias("median_amount"),
        decile(0.9).alias("p90_amount"),
    ]


def header(cube: DataFrame, selection: Selection = Selection(), bands: Sequence[float] = BANDS) -> DataFrame:
    """One row: processes, amount, share of single bids, departments, buyers and deciles of the selection."""
    return cube.filter(selection.where(bands)).agg(*_measures(), F.count_distinct("department").alias("departments"))


def tables(cube: DataFrame, selection: Selection = Selection(), bands: Sequence[float] = BANDS) -> DataFrame:
    """(dimension, value, measures...): one table per dimension, all in one pass over the selection's cells."""
    chosen = cube.filter(selection.where(bands)).withColumn("band", F.col("band").cast("string"))
    sets = chosen.groupingSets([[F.col(d)] for d in DIMENSIONS], *DIMENSIONS).agg(*_measures(), *(F.grouping(d).alias(f"_{d}") for d in DIMENSIONS))
    which = F.coalesce(*(F.when(F.col(f"_{d}") == 0, d) for d in DIMENSIONS))
    value = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d)) for d in DIMENSIONS))
    return sets.select(which.alias("dimension"), value.alias("value"), "processes", "amount", "single_rate", "buyers", "median_amount", "p90_amount")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
