"""Rates of single bids by group, with confidence intervals and the effect of minimum sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.filters import step_counts

MINIMA = (1, 5, 10, 15, 20, 30)
PERCENTILES = (25, 50, 75, 90, 95, 99)


def universe(processes: DataFrame, competitive: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(processes that count, with ``single_bid``; rows left after each step, in one pass)."""
    steps = {
        "analysed": F.col("in_analysis"),
        "awarded": F.col("n_awards") > 0,
        "competitive": F.col("method").isin(list(competitive)),
        "with_bidders": F.col("n_bidders").isNotNull(),
        "single": F.col("n_bidders") == 1,
    }
    kept = processes.filter("in_analysis and n_awards > 0 and n_bidders is not null").filter(steps["competitive"])
    return kept.withColumn("single_bid", steps["single"]), step_counts(processes, steps)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval within [0, 1]; (0, 0) without cases."""
    n, hits = n.cast("double"), hits.cast("double")
    share, spread = hits / n, z * z / n
    centre = share + spread / 2
    half = z * F.sqrt(share * (1 - share) / n + spread / (4 * n))
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / (1 + spread)))
    high = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), (centre + half) / (1 + spread)))
    return low, high


def rate_by(universe: DataFrame, by: str, flag: str, names: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Cases, flagged cases, rate and interval of each group of at least ``least`` cases; ``names`` by mode."""
    counted = universe.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(flag).alias("flagged"), *(F.mode(c, True).alias(c) for c in names)).filter(F.col("cases") >= least)
    low, high = wilson(F.col("flagged"), F.col("cases"))
    return counted.withColumns({"rate": F.round(F.col("flagged") / F.col("cases"), 4), "low": F.round(low, 4), "high": F.round(high, 4)})


def ranked(rates: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Highest rates first; the group itself breaks ties."""
    out = rates.orderBy(F.desc("rate"), F.desc("flagged"), F.desc("cases"), F.asc(by))
    return out if n is None else out.limit(n)


def ties_at_cut(rates: DataFrame, by: str, n: int) -> DataFrame:
    """The rate at place ``n``, and how many groups have it inside and in all."""
    top = ranked(rates, by, n)
    cut = top.agg(F.min("rate").alias("cut_rate"))
    inside = top.join(F.broadcast(cut), F.col("rate") == F.col("cut_rate")).agg(F.count("*").alias("inside"))
    overall = rates.join(F.broadcast(cut), F.col("rate") == F.col("cut_rate")).agg(F.max("cut_rate").alias("cut_rate"), F.count("*").alias("in_all"))
    # one row each
    return overall.join(F.broadcast(inside))


def minimum_sizes(universe: DataFrame, by: str, flag: str, minima: Sequence[int] = MINIMA) -> DataFrame:
    """For each minimum size: groups and cases left, what one case weighs, the highest rate.

    One row per group is spread over the few minima it reaches, then summed.
    """
    groups = universe.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))
    reached = groups.withColumn("least", F.explode(F.filter(F.array(*map(F.lit, minima)), lambda m: m <= F.col("n"))))
    per = reached.groupBy("least").agg(F.count("*").alias("groups"), F.sum("n").alias("cases"), F.round(F.max(F.col("flagged") / F.col("n")), 3).alias("highest_rate"))
    total = groups.agg(F.count("*").alias("all_groups"), F.sum("n").alias("all_cases"))
    wanted = universe.sparkSession.createDataFrame([(m,) for m in minima], "least int")
    joined = wanted.join(per, "least", "left").join(F.broadcast(total))
    return joined.select(
        "least",
        F.coalesce("groups", F.lit(0)).alias("groups"),
        F.round(F.coalesce("groups", F.lit(0)) / F.col("all_groups"), 3).alias("share_of_groups"),
        F.coalesce("cases", F.lit(0)).alias("cases"),
        F.round(F.coalesce("cases", F.lit(0)) / F.col("all_cases"), 3).alias("share_of_cases"),
        F.round(1 / F.col("least"), 3).alias("weight_of_one"),
        "highest_rate",
    )


def size_percentiles(universe: DataFrame, by: str, percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """Percentiles of the group sizes, interpolated and cut to whole numbers."""
    sizes = universe.groupBy(by).agg(F.count("*").alias("n"))
    values = F.percentile("n", F.array(*(F.lit(p / 100) for p in percentiles)))
    return sizes.agg(*(F.floor(F.get(values, i)).cast("int").alias(f"p{p}") for i, p in enumerate(percentiles)))
