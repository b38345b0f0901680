"""Evaluation of an engine from its saved runs, without calling it again.

A run is a row per question: what was asked for and found as filters, the best
similarity, the model's verdict, what was cited, what it cost.  States at any
threshold, found and cited ids, and the accuracy of the filters follow by
joins with what is relevant now, so a corrected gold table needs no new run.

Kinds of questions: ``inside`` the corpus, ``empty`` (filters that nothing
meets) and ``outside``.  Defined results: a run with an error or without
results never abstains; a null score is below no threshold; a question asked
twice counts twice; ids that are cited twice count once; a question that has
no relevant row is not found.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestar.operators.metrics import field_matches
from lodestar.sources.files import read_csv

RUN = (
    "id string, kind string, error string, wanted map<string,string>, found map<string,string>, top_score double, gold_score double, "
    "model_abstained boolean, no_results boolean, cited array<string>, invalid array<string>, cost_usd double, calls int"
)


def read_runs(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    """Runs saved as CSV: filters as JSON, ids parted by blanks, flags as 0 and 1, anything missing empty.

    ``names`` gives the file's column for each of ours.
    """
    with_header = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = read_csv(spark, path, ", ".join(f"`{c}` string" for c in with_header.columns))
    at = lambda c: F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")
    ids = lambda c: F.filter(F.split(F.coalesce(at(c), F.lit("")), " "), lambda x: x != "")
    flag = lambda c: F.coalesce(at(c).try_cast("int"), F.lit(0)) == 1
    filters = lambda c: F.from_json(F.coalesce(at(c), F.lit("{}")), "map<string,string>")
    return raw.select(
        at("id").alias("id"), at("kind").alias("kind"), F.nullif(at("error"), F.lit("")).alias("error"), filters("wanted").alias("wanted"), filters("found").alias("found"),
        at("top_score").try_cast("double").alias("top_score"), at("gold_score").try_cast("double").alias("gold_score"), flag("model_abstained").alias("model_abstained"), flag("no_results").alias("no_results"),
        ids("cited").alias("cited"), ids("invalid").alias("invalid"), at("cost_usd").try_cast("double").alias("cost_usd"), at("calls").try_cast("int").alias("calls"),
    )


def _flags(runs: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull()
    return runs.withColumns({"_failed": failed, "_answered": ~failed & ~F.col("no_results") & ~F.col("model_abstained")})


def states(runs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, id, kind, state): error, no results, below the threshold, turned away by the model, or answered."""
    each = runs.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    low = F.coalesce(F.round("top_score", 4) < F.col("threshold"), F.lit(False))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("no_results"), "no results").when(low, "below threshold").when(F.col("model_abstained"), "turned away").otherwise("answered")
    return each.select("threshold", "id", "kind", state.alias("state"))


def options(runs: DataFrame, thresholds: Sequence[float], listed: int = 20) -> DataFrame:
    """A row per threshold: the gate on the gold filters alone, the final abstentions, the drafting calls, and the first ids lost and let through."""
    each = runs.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    kept = F.col("error").isNull() & ~F.col("no_results")
    low = lambda score: F.coalesce(F.round(score, 4) < F.col("threshold"), F.lit(False))
    final = kept & (low("top_score") | F.col("model_abstained"))
    inside, outside = F.col("kind") == "inside", F.col("kind") == "outside"
    marked = each.withColumns({"_final": final, "_lost": inside & final, "_through": outside & ~final & ~F.col("no_results")})
    counts = marked.groupBy("threshold").agg(
        F.count_if(outside).alias("outside"), F.count_if(inside).alias("inside"),
        F.count_if(outside & low("gold_score")).alias("gate_right"), F.count_if(inside & low("gold_score")).alias("gate_wrong"),
        F.count_if(outside & final).alias("final_right"), F.count_if("_lost").alias("final_wrong"), F.count_if("_through").alias("let_through"),
        F.count_if(~F.col("no_results") & F.col("top_score").isNotNull() & ~low("top_score")).alias("drafting_calls"),
    )
    for flag, name in (("_lost", "lost_ids"), ("_through", "let_through_ids")):
        first = marked.filter(flag).withColumn("_n", F.row_number().over(W.partitionBy("threshold").orderBy("id"))).filter(F.col("_n") <= listed)
        counts = counts.join(first.groupBy("threshold").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias(name)), "threshold", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return counts


def citations(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """(id, cites_relevant) of the answered questions inside: whether any cited id is in ``relevant`` (id, item)."""
    answered = _flags(runs).filter("_answered AND kind = 'inside'").select("id", "cited").withColumn("_row", F.monotonically_increasing_id())
    named = answered.select("_row", "id", F.explode_outer(F.array_distinct("cited")).alias("item"))
    known = relevant.select("id", "item").distinct().withColumn("_hit", F.lit(1))
    return named.join(known, ["id", "item"], "left").groupBy("_row", "id").agg((F.count("_hit") > 0).alias("cites_relevant")).drop("_row")


def found_within(runs: DataFrame, hits: DataFrame, relevant: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: the share of questions inside with a relevant item among the first k of ``hits`` (id, rank, item)."""
    known = relevant.select("id", "item").distinct()
    best = hits.join(known, ["id", "item"], "left_semi").groupBy("id").agg(F.min("rank").alias("_first"))
    inside = runs.filter("kind = 'inside'").select("id").join(best, "id", "left")
    return inside.agg(F.count("*").alias("questions"), *(F.round(F.avg(F.coalesce(F.col("_first") <= k, F.lit(False)).cast("int")), 3).alias(f"recall_{k}") for k in ks))


def field_results(runs: DataFrame, names: Sequence[str], numeric: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """One row: the filters that were extracted right, by field and all together; numbers within ``tolerance``."""
    get = lambda column, name: F.try_element_at(column, F.lit(name))
    right: dict[str, Column] = {}
    for name in names:
        wanted, got = get("wanted", name), get("found", name)
        right[name] = field_matches(wanted.try_cast("double"), got.try_cast("double"), True, tolerance) if name in numeric else field_matches(wanted, got)
    every = F.lit(True)
    for condition in right.values():
        every = every & condition
    return runs.agg(F.count("*").alias("questions"), *(F.count_if(c).alias(f"right_{n}") for n, c in right.items()), F.count_if(every).alias("all_right"))


def summary(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: questions, costs, errors, empty selections seen as such, answers, and how many cite something relevant or invalid."""
    flagged = _flags(runs)
    kind = lambda k: F.col("kind") == k
    counts = flagged.agg(
        F.count("*").alias("questions"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.count_if("_failed").alias("errors"),
        F.count_if(kind("empty")).alias("empty"), F.count_if(kind("empty") & F.col("no_results")).alias("empty_right"),
        F.count_if(kind("outside") & F.col("no_results")).alias("outside_without_results"), F.count_if(kind("inside") & F.col("no_results")).alias("inside_without_results"),
        F.count_if(kind("inside") & F.col("_answered")).alias("answered_inside"), F.count_if(F.size("invalid") > 0).alias("with_invalid_ids"),
    )
    # one row each
    return counts.join(F.broadcast(citations(runs, relevant).agg(F.count_if("cites_relevant").alias("cite_relevant"))))


def pages_cited(runs: DataFrame, cited: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for a document engine: answered questions inside, and those that cite an expected page.

    ``cited`` and ``expected`` are (id, document, page); see ``evaluation.expected_pages``.
    """
    page = lambda df: df.select("id", F.concat_ws(":", "document", F.col("page").cast("string")).alias("item"))
    gathered = page(cited).groupBy("id").agg(F.collect_set("item").alias("cited"))
    judged = citations(runs.drop("cited").join(gathered, "id", "left"), page(expected))
    return judged.agg(F.count("*").alias("answered"), F.count_if("cites_relevant").alias("cite_expected"))


def as_json(row) -> str:
    """A one-row report for a file."""
    return json.dumps(row.asDict(recursive=True), ensure_ascii=False, sort_keys=True)
