"""Ground truth, retrieval runs, thresholds, engine runs and model comparisons, as tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from lodestar.functions.text import accent_key, pages_of
from lodestar.operators.filters import by_words, structured
from lodestar.operators.metrics import abstention_rates, auc, field_accuracy, retrieval_by_question, retrieval_summary, threshold_options, threshold_sweep, with_hits
from lodestar.operators.quantiles import exclusive, same_keys
from lodestar.operators.search import top_k_per_query
from lodestar.sources.files import Definition


def ground_truth(processes: DataFrame, definitions: Sequence[Definition], text: str = "text") -> DataFrame:
    """(question, id): rows that meet a definition's filters and words; each definition is one filtered scan."""
    parts = []
    for d in definitions:
        words = by_words(F.lower(accent_key(F.col(text))), [w.lower() for w in d.include], [w.lower() for w in d.exclude])
        parts.append(processes.filter(structured(d.filters) & words).select(F.lit(d.id).alias("question"), "id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def expected_pages(questions: DataFrame, spec: str = "expected_pages") -> DataFrame:
    """(question, document, page) from ``doc:1,2;doc:3``."""
    return questions.select(F.col("id").alias("question"), F.explode(pages_of(F.col(spec))).alias("p")).select("question", "p.document", "p.page").distinct()


def retrieval_run(corpus: DataFrame, queries: DataFrame, relevant: DataFrame, ks: Sequence[int], on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(per question, summary) of searching ``corpus`` with every query."""
    hits = top_k_per_query(corpus, queries, max(ks))
    by_question = retrieval_by_question(with_hits(hits, relevant, on), "query_id", ks)
    return by_question, retrieval_summary(by_question, ks)


def engine_report(answers: DataFrame, gold: DataFrame, fields: Mapping[str, tuple[str, str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(abstention rates, field accuracy) of saved answers (id, abstained, fields) against gold (id, outside, fields)."""
    joined = answers.join(gold, "id")
    return abstention_rates(joined, "abstained", "outside"), field_accuracy(joined, dict(fields))


def gate_report(runs: DataFrame, thresholds: Sequence[float], call_cost: float) -> tuple[DataFrame, DataFrame]:
    """(sweep, options) of a run without gate (id, score, outside, verdict)."""
    return threshold_sweep(runs, "score", "outside", thresholds), threshold_options(runs, thresholds, call_cost)


def model_comparison(runs: DataFrame, ks: Sequence[int], scores: DataFrame | None = None) -> DataFrame:
    """One row per model from its hits (model, question, rank, hit, latency_ms, cost): recall, rank, latency, cost.

    With ``scores`` (model, question, score, inside: each question's best
    similarity) also the AUC of inside against outside, the range of both, and
    how many outside are above the lowest inside.  The ninth decile of the
    latency is the exclusive one.
    """
    keyed = runs.withColumn("_question", F.struct("model", "question"))
    by = retrieval_by_question(keyed, "_question", ks).withColumn("model", F.col("_question.model"))
    quality = by.groupBy("model").agg(F.count("*").alias("questions"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"), *(F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in ks))
    first = runs.filter("rank = 1")
    once = first.groupBy("model").agg(F.round(F.avg("latency_ms"), 2).alias("mean_ms"), F.round(F.sum("cost"), 6).alias("cost"))
    late = exclusive(first, ["model"], "latency_ms", 0.9, "p90").select("model", F.round("p90", 2).alias("p90_ms"))
    out = same_keys(same_keys(quality, once, ["model"]), late, ["model"])
    if scores is None:
        return out
    side = lambda inside: F.when(F.col("inside") if inside else ~F.col("inside"), F.col("score"))
    ranges = scores.groupBy("model").agg(*(f(side(i)).alias(f"{'inside' if i else 'outside'}_{n}") for i in (True, False) for n, f in (("least", F.min), ("most", F.max))))
    above = same_keys(scores, ranges.select("model", "inside_least"), ["model"]).groupBy("model").agg(F.count_if(~F.col("inside") & (F.col("score") > F.col("inside_least"))).alias("outside_above"))
    return same_keys(same_keys(same_keys(out, auc(scores, "score", "inside", by=["model"]), ["model"]), ranges, ["model"]), above, ["model"])


#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ... 8.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def paired_differences(by_question: DataFrame, base: str, measures: Sequence[str], replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """(model, measure, questions, difference, low, high, above): each model against ``base`` on the questions that both have.

    Intervals are those of a bootstrap: every question weighs a Poisson number
    of times in every replicate, drawn from a hash of both, so the same
    question weighs the same for all models, a rerun gives the same interval,
    and all replicates are one aggregation.  ``above`` is the share of
    replicates in which the model is ahead.  Rows are (model, question,
    measures...), one each; a null measure leaves its question out.
    """
    reference = by_question.filter(F.col("model") == base).select("question", *(F.col(m).cast("double").alias(f"_{m}") for m in measures))
    apart = by_question.filter(F.col("model") != base).join(reference, "question")
    rows = apart.select("model", "question", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), (F.col(m) - F.col(f"_{m}")).alias("d")) for m in measures))).alias("x")).select("model", "question", "x.*").filter("d IS NOT NULL")
    draw = F.pmod(F.xxhash64("question", "replicate"), F.lit(1 << 32)) / (1 << 32)
    weight = F.lit(0)
    for share in POISSON:
        weight = weight + (draw >= share).cast("int")
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("model", "measure", "replicate").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    ends = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    spread = means.groupBy("model", "measure").agg(F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"), F.avg((F.col("mean") > 0).cast("int")).alias("above"))
    return rows.groupBy("model", "measure").agg(F.count("*").alias("questions"), F.avg("d").alias("difference")).join(spread, ["model", "measure"])


def separation(scores: DataFrame) -> DataFrame:
    """AUC of the best similarity (score) of questions inside against those outside (positive)."""
    return auc(scores, "score", "positive")
