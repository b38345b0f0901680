"""Mixing sources to target weights by fitting a subset of documents to each budget.

Sizes are counted exactly per (source, length).  A source whose budget is
more than its own words first takes every document whole times; the budget
left is met by a bounded-knapsack dynamic program over the length counts,
and for each length that many documents are selected by a seeded hash.

Only totals per source reach the driver.  Lengths are planned per source, the
hash bound of a length is found from counts in 256 hash buckets and then
inside one bucket, so no source or length, however large, meets in one task.

Defined results: a null text has size 0 and a null source is a source of its
own, last in order; documents of size 0 take nothing; rows equal in id and
text are told apart only by number, so a rerun takes as many of them; very
long texts count whole, and one longer than its source's budget may be taken
where that is nearer; an empty table gives no rows; other columns are kept by
``apply_mix``.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm.scratch import stored

SPACES = r"[^\x20\x09-\x0D]+"
DP_BUDGET = 1 << 17
#: How far above the budget the program looks at least, up to the longest document.
OVER = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: Iterable[int], most: int) -> list[Fraction]:
    """Shares of all sizes by weight, none above ``most`` times its own size."""
    weights, out = list(weights), [Fraction(0)] * len(sizes)
    rest, active = Fraction(sum(sizes)), set(range(len(sizes)))
    while active:
        whole = sum(weights[i] for i in active)
        over = {i for i in active if rest * weights[i] > most * sizes[i] * whole}
        if not over:
            for i in active:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        rest -= sum(out[i] for i in over)
        active -= over
    return out


def few_sums(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray | None:
    """The selection whose words are nearest to ``budget``, from all its reachable sums; None if these are over ``DP_BUDGET``."""
    sums, by = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i, (length, left) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, group = min(left, 2 * budget // length), 1
        while left:
            group = min(group, left)
            # no sum over twice the budget is nearer than nothing
            new = np.setdiff1d(sums + group * length, sums, assume_unique=True)
            new = new[new <= 2 * budget]
            if len(sums) + len(new) > DP_BUDGET:
                return None
            order = np.argsort(np.concatenate([sums, new]), kind="stable")
            sums, by = np.concatenate([sums, new])[order], np.concatenate([by, np.full(len(new), len(items))])[order]
            items.append((i, group))
            left -= group
            group *= 2
    take, at = np.zeros(len(lengths), dtype=np.int64), int(np.abs(sums - budget).argmin())
    while by[at] >= 0:
        i, group = items[by[at]]
        take[i] += group
        at = int(np.searchsorted(sums, sums[at] - group * lengths[i]))
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words meet ``budget``.

    Lengths are measured in their common step.  A budget within the program's
    table of ``DP_BUDGET`` steps is met as nearly as any selection can, and so
    is a larger one where the documents, being few or alike, have no more than
    that many sums.  Any other is first met by the proportional share of all
    lengths; single documents in turn bring the rest within the table, which
    then finds the nearest reachable sum to what is left.  If every document
    left is longer than a rest that is over the table, the shortest is taken
    where that is nearer.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    step = int(np.gcd.reduce(lengths))
    if step > 1:
        return fit_budget(lengths // step, counts, (2 * budget + step) // (2 * step))
    if budget > DP_BUDGET and (exact := few_sums(lengths, counts, budget)) is not None:
        return exact
    share = budget if budget > DP_BUDGET else 0
    take = np.array([int(n) * share // total for n in counts], dtype=np.int64)
    rest = budget - int((lengths * take).sum())
    order = np.random.default_rng(len(lengths)).permutation(len(lengths))
    while rest > DP_BUDGET:
        before = rest
        for i in order:
            if rest > DP_BUDGET and take[i] < counts[i] and lengths[i] <= rest:
                take[i] += 1
                rest -= int(lengths[i])
        if rest == before:
            break
    if rest > DP_BUDGET:
        left = np.flatnonzero(take < counts)
        i = left[lengths[left].argmin()]
        take[i] += int(lengths[i]) < 2 * rest
        return take
    # sums above the budget count too: the nearest one is taken, and none over twice the rest is nearer than nothing
    goal = rest
    most = goal + min(int(lengths.max()), max(OVER, goal))
    reached = np.zeros(most + 1, dtype=bool)
    reached[0] = True
    by = np.full(most + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        left, group = min(int(counts[i] - take[i]), most // int(lengths[i])), 1
        while left and not reached[goal]:
            group = min(group, left)
            step = group * int(lengths[i])
            if step <= most:
                new = np.flatnonzero(reached[: most + 1 - step] & ~reached[step:]) + step
                reached[new], by[new] = True, len(items)
                items.append((int(i), group))
            left -= group
            group *= 2
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at:
        i, group = items[by[at]]
        take[i] += group
        at -= group * int(lengths[i])
    return take


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Source key in order (null last), size, and a seeded hash of the row."""
    return docs.withColumns(
        {
            "mix_source": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))),
            "mix_size": n_words(F.col("text").cast("string")),
            "mix_hash": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    )


def plan_mix(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per (source, size): target, whole repeats, hash bound and how many to take at the bound."""
    spark = rows.sparkSession
    bucket = F.shiftrightunsigned("mix_hash", 56)
    counts = stored(rows.groupBy("mix_source", "mix_size", bucket.alias("mix_bucket")).agg(F.count("*").alias("n")), "mix-counts")
    totals = sorted((r.mix_source, int(r.words)) for r in counts.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("words")).collect())
    targets = water_fill([n for _, n in totals], (weights[i % len(weights)] for i in range(len(totals))), most)
    sources = spark.createDataFrame(
        [(s, n, float(t), int(min(most, t // n)) if n else 0, round(t - n * min(most, t // n)) if n else 0) for (s, n), t in zip(totals, targets, strict=True)],
        "mix_source string, source_size long, target double, repeats long, budget long",
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["mix_source", "mix_size"]].copy()
        lengths, n = pdf["mix_size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        some = lengths > 0
        extra = np.zeros(len(pdf), dtype=np.int64)
        if some.any() and pdf["budget"].iloc[0] > 0:
            ranked = np.flatnonzero(some)[np.argsort(lengths[some], kind="stable")]
            extra[ranked] = fit_budget(lengths[ranked], n[ranked], int(pdf["budget"].iloc[0]))
        out["extra"] = extra
        return out

    lengths = counts.groupBy("mix_source", "mix_size").agg(F.sum("n").alias("n")).join(sources.select("mix_source", "budget"), "mix_source")
    extra = stored(lengths.groupBy("mix_source").applyInPandas(fit, "mix_source string, mix_size long, extra long"), "mix-extra")
    # the bucket that holds the last document to take, then its hash in there
    by_bucket = W.partitionBy("mix_source", "mix_size").orderBy("mix_bucket")
    # written, so that the next join is dealt by bucket too and not by length alone
    cut = stored(
        counts.join(extra.filter("extra > 0"), ["mix_source", "mix_size"])
        .withColumn("before", F.sum("n").over(by_bucket) - F.col("n"))
        .filter("before < extra and before + n >= extra")
        .select("mix_source", "mix_size", "mix_bucket", (F.col("extra") - F.col("before")).alias("wanted")),
        "mix-cut",
    )
    inside = rows.select("mix_source", "mix_size", "mix_hash", bucket.alias("mix_bucket")).join(cut, ["mix_source", "mix_size", "mix_bucket"])
    per_hash = inside.groupBy("mix_source", "mix_size", "mix_hash", "wanted").agg(F.count("*").alias("n"))
    by_hash = W.partitionBy("mix_source", "mix_size").orderBy("mix_hash")
    bound = (
        per_hash.withColumn("before", F.sum("n").over(by_hash) - F.col("n"))
        .filter("before < wanted and before + n >= wanted")
        .select("mix_source", "mix_size", F.col("mix_hash").alias("bound"), (F.col("wanted") - F.col("before")).alias("at_bound"), F.col("n").alias("n_bound"))
    )
    sizes = extra.select("mix_source", "mix_size").join(sources.drop("budget"), "mix_source")
    # written, so that a join with it may split a large length
    return stored(sizes.join(bound, ["mix_source", "mix_size"], "left"), "mix-plan")


def _unsigned(hash_column: str) -> Column:
    """The order of the buckets: as unsigned, then as signed inside a bucket."""
    return F.struct(F.shiftrightunsigned(hash_column, 56), F.col(hash_column))


def mix_table(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken of it."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    # rows of one hash are numbered before the join, which then may split a large length
    same = W.partitionBy("mix_hash", "mix_source", "mix_size").orderBy("doc_id")
    rows = stored(_keyed(narrow, seed).drop("text", "source").withColumn("mix_number", F.row_number().over(same)), "mix-rows")
    planned = rows.join(plan_mix(rows, weights, most), ["mix_source", "mix_size"])
    extra = F.when(_unsigned("mix_hash") < _unsigned("bound"), 1).when((F.col("mix_hash") == F.col("bound")) & (F.col("mix_number") <= F.col("at_bound")), 1).otherwise(0)
    return planned.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * (F.col("repeats") + extra)).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, rows not taken left out."""
    rows = stored(_keyed(docs.select("doc_id", "text", "source"), seed).drop("text", "source"), "mix-rows")
    plan = plan_mix(rows, weights, most)
    packed = _keyed(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("mix_row")), seed).drop("doc_id", "text", "source")
    planned = packed.join(plan, ["mix_source", "mix_size"])
    below, same = _unsigned("mix_hash") < _unsigned("bound"), F.coalesce(F.col("mix_hash") == F.col("bound"), F.lit(False))
    extra = F.when(below | same, 1).otherwise(0)
    # only repeated rows share a hash; where not all at the bound are taken, they alone are numbered
    if plan.filter("at_bound < n_bound").limit(1).count():
        split = same & (F.col("at_bound") < F.col("n_bound"))
        numbered = planned.filter(split).withColumn("mix_number", F.row_number().over(W.partitionBy("mix_hash", "mix_source", "mix_size").orderBy(F.lit(0))))
        planned = planned.filter(~split).withColumn("mix_number", F.lit(0)).unionByName(numbered)
        extra = F.when(below | (same & (F.col("mix_number") <= F.col("at_bound"))), 1).otherwise(0)
    times = F.when(F.col("mix_size") > 0, F.col("repeats") + extra).otherwise(0).cast("int")
    return planned.withColumn("mix_times", times).filter("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("mix_row.*")
