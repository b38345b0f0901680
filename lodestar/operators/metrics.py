"""Measures of retrieval and of answering with abstention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.operators.quantiles import same_keys


def with_hits(hits: DataFrame, relevant: DataFrame, on: Sequence[str]) -> DataFrame:
    """Retrieved rows with ``hit``: whether ``relevant`` has the same ``on``."""
    known = relevant.select(*on).distinct().withColumn("_known", F.lit(True))
    return hits.join(known, list(on), "left").withColumn("hit", F.col("_known").isNotNull()).drop("_known")


def retrieval_by_question(hits: DataFrame, question: str, ks: Sequence[int], complies: Column | None = None) -> DataFrame:
    """Per question (columns ``rank`` from 1, ``hit``): found within k, precision at k, compliance at k, reciprocal rank.

    Precision divides by k; compliance by what was returned within k.
    """
    met = F.col("hit") if complies is None else complies
    parts: list[Column] = [F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit")]
    for k in ks:
        within = F.col("rank") <= k
        parts += [
            F.max((within & F.col("hit")).cast("int")).alias(f"recall_{k}"),
            (F.count_if(within & F.col("hit")) / k).alias(f"precision_{k}"),
            F.avg(F.when(within, met.cast("double"))).alias(f"compliance_{k}"),
        ]
    return hits.groupBy(question).agg(*parts)


def retrieval_summary(by_question: DataFrame, ks: Sequence[int]) -> DataFrame:
    means = [F.round(F.avg(f"{name}_{k}"), 4).alias(f"{name}_{k}") for k in ks for name in ("recall", "precision", "compliance")]
    return by_question.agg(F.count("*").alias("questions"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), *means)


def auc(scores: DataFrame, score: str, positive: str, steps: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties as half, of all rows or of each ``by``; scores of bounded range, as similarities are.

    By counts of equal scores and running totals, so pairs are never made:
    totals of ``steps`` parts of the unit first, then inside each part.  A
    group without a positive or without a negative has a null.
    """
    counted = scores.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    counted = counted.withColumn("part", F.floor(F.col("s") * steps))
    before = F.coalesce(F.sum("part_neg").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counted.groupBy(*by, "part").agg(F.sum("neg").alias("part_neg")).select(*by, "part", before.alias("before"))
    inside = F.coalesce(F.sum("neg").over(W.partitionBy(*by, "part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = same_keys(counted.withColumn("inside", inside), parts, [*by, "part"])
    total = F.sum(F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2))
    area = F.round(total / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc")
    return ranked.groupBy(*by).agg(area) if by else ranked.agg(area)


def threshold_sweep(scores: DataFrame, score: str, outside: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: abstentions that are right (questions outside) and wrong (inside).

    A threshold's row sums what falls below it; the thresholds are a fixed
    list inside each row, no join.
    """
    reached = scores.select(F.col(outside).alias("outside"), F.explode(F.filter(F.array(*map(F.lit, map(float, thresholds))), lambda t: F.col(score) < t)).alias("threshold"))
    per = reached.groupBy("threshold").agg(F.count_if("outside").alias("right"), F.count_if(~F.col("outside")).alias("wrong"))
    total = scores.agg(F.count_if(outside).alias("n_outside"), F.count_if(~F.col(outside)).alias("n_inside"))
    wanted = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    joined = wanted.join(per, "threshold", "left").join(F.broadcast(total))
    right, wrong = F.coalesce("right", F.lit(0)), F.coalesce("wrong", F.lit(0))
    return joined.select("threshold", right.alias("right"), wrong.alias("wrong"), F.round(right / F.col("n_outside"), 4).alias("right_rate"), F.round(wrong / F.col("n_inside"), 4).alias("wrong_rate"))


def threshold_options(runs: DataFrame, thresholds: Sequence[float], call_cost: float) -> DataFrame:
    """Per threshold, from a run without gate (id, score, outside, verdict): the gate alone, and gate or verdict.

    Also the calls made, what they cost, and all questions wrongly turned away
    by their text; ``turned_away`` has them as rows.
    """
    each = runs.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    gate = F.round("score", 4) < F.col("threshold")
    final = gate | F.col("verdict")
    counts = each.groupBy("threshold").agg(
        F.count_if(gate & F.col("outside")).alias("gate_right"),
        F.count_if(gate & ~F.col("outside")).alias("gate_wrong"),
        F.count_if(final & F.col("outside")).alias("final_right"),
        F.count_if(final & ~F.col("outside")).alias("final_wrong"),
        F.count_if(~gate).alias("calls"),
        F.round(F.count_if(~gate) * call_cost, 6).alias("cost"),
        F.round(F.min(F.when(~F.col("outside"), F.col("score"))) - F.first("threshold"), 4).alias("margin"),
    )
    # sorted and joined by the ids' first characters, so that no task sorts all ids
    parts = turned_away(runs, thresholds).groupBy("threshold", F.left("id", F.lit(4)).alias("first")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    names = parts.groupBy("threshold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "ids"))), lambda p: p["ids"]), ",").alias("wrongly_gated"))
    return counts.join(names, "threshold", "left").withColumn("wrongly_gated", F.coalesce("wrongly_gated", F.lit("")))


def turned_away(runs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, id as text) of every question inside that the gate alone would turn away."""
    each = runs.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    return each.filter((F.round("score", 4) < F.col("threshold")) & ~F.col("outside")).select("threshold", F.col("id").cast("string").alias("id"))


def abstention_rates(answers: DataFrame, abstained: str, outside: str) -> DataFrame:
    return answers.agg(
        F.count_if(outside).alias("outside"),
        F.count_if(~F.col(outside)).alias("inside"),
        F.count_if(F.col(outside) & F.col(abstained)).alias("abstained_right"),
        F.count_if(~F.col(outside) & F.col(abstained)).alias("abstained_wrong"),
        F.round(F.count_if(F.col(outside) & F.col(abstained)) / F.count_if(outside), 4).alias("right_rate"),
        F.round(F.count_if(~F.col(outside) & F.col(abstained)) / F.count_if(~F.col(outside)), 4).alias("wrong_rate"),
    )


def field_matches(wanted: Column, got: Column, numeric: bool = False, tolerance: float = 0.01) -> Column:
    """Equal, both missing, or (numbers) within ``tolerance`` of the wanted value."""
    same = F.abs(wanted - got) <= tolerance * F.greatest(F.abs(wanted), F.lit(1.0)) if numeric else wanted == got
    return F.when(wanted.isNull() | got.isNull(), wanted.isNull() & got.isNull()).otherwise(same)


def field_accuracy(pairs: DataFrame, fields: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """Right values of each field (name: wanted column, got column, numeric), and rows with all right."""
    right = {name: field_matches(F.col(a), F.col(b), numeric) for name, (a, b, numeric) in fields.items()}
    every = F.lit(True)
    for condition in right.values():
        every = every & condition
    return pairs.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"right_{name}") for name, c in right.items()), F.count_if(every).alias("all_right"))


def reading_order(pages: DataFrame, by: str, position: str, value: str) -> DataFrame:
    """Share of steps that do not go back."""
    step = F.col(value) >= F.lag(value).over(W.partitionBy(by).orderBy(position))
    return pages.withColumn("_step", step).groupBy(by).agg(F.round(F.avg(F.col("_step").cast("int")), 4).alias("in_order"))
