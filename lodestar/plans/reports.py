"""Reports and dashboard tables; an empty selection gives zeros, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.filters import legibility
from lodestar.operators.lookups import over_dimension
from lodestar.operators.metrics import auc, reading_order, retrieval_by_question
from lodestar.operators.quantiles import described, exclusive, same_keys
from lodestar.operators.risk import minimum_sizes, ranked, rate_by, size_percentiles, ties_at_cut, universe


def kpis(processes: DataFrame, amount: str, valid: str, area: str, single: str) -> DataFrame:
    """Count, valid amount, areas and share of single bids."""
    return processes.agg(
        F.count("*").alias("processes"),
        F.round(F.coalesce(F.sum(F.when(F.col(valid), F.col(amount))), F.lit(0.0)), 2).alias("amount"),
        F.count_distinct(area).alias("areas"),
        F.coalesce(F.round(F.count_if(single) / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("single_rate"),
    )


def distribution(processes: DataFrame, by: str, amount: str, valid: str) -> DataFrame:
    return processes.groupBy(by).agg(F.count("*").alias("processes"), F.round(F.coalesce(F.sum(F.when(F.col(valid), F.col(amount))), F.lit(0.0)), 2).alias("amount"))


def map_table(areas: DataFrame, processes: DataFrame, by: str, amount: str, valid: str) -> DataFrame:
    """Every area, zero where nothing falls."""
    return over_dimension(areas, distribution(processes, by, amount, valid), by, ["processes", "amount"])


def call_costs(calls: DataFrame) -> DataFrame:
    """Calls, failures, tokens and cost of each model."""
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.round(F.sum(F.col("cost_usd").try_cast("double")), 6).alias("cost_usd"),
    )


def last_calls(calls: DataFrame, n: int = 20) -> DataFrame:
    return calls.orderBy(F.desc("called_at"), F.asc("question")).limit(n)


def page_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: pages kept and dropped, characters before and after."""
    a = before.groupBy("document").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars_before"))
    b = after.groupBy("document").agg(F.count("*").alias("pages_kept"), F.sum(F.length("text")).alias("chars_after"))
    joined = a.join(b, "document", "left").fillna(0, subset=["pages_kept", "chars_after"])
    return joined.withColumn("pages_dropped", F.col("pages") - F.col("pages_kept"))


def note_counts(register: DataFrame) -> DataFrame:
    return register.groupBy("document", "action").agg(F.count("*").alias("notes"))


def length_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Least, median, most and ninth decile of the lengths."""
    sized = chunks.select(F.length(text).cast("long").alias("chars"))
    return sized.agg(F.count("*").alias("chunks"), F.min("chars").alias("least"), F.median("chars").alias("median"), F.max("chars").alias("most"), F.round(F.percentile("chars", F.lit(0.9)), 2).alias("p90"))


def length_p90_exclusive(chunks: DataFrame, by: str, text: str = "text") -> DataFrame:
    """The exclusive ninth decile of each configuration."""
    return exclusive(chunks.select(by, F.length(text).alias("chars")), [by], "chars", 0.9, "p90").select(by, F.round("p90", 2).alias("p90_exclusive"))


def chunk_sizes(chunks: DataFrame, by: Sequence[str], tokens: Column, limit: int, text: str = "text") -> DataFrame:
    """A row per configuration: chunks, characters and tokens (least, median, ninth decile, most), and chunks over the limit.

    ``tokens`` counts what the model sees.  Medians and exclusive deciles are
    cut to whole numbers.
    """
    sized = chunks.select(*by, F.length(text).cast("long").alias("chars"), tokens.cast("long").alias("tokens"))
    measures = sized.select(*by, F.explode(F.create_map(F.lit("chars"), "chars", F.lit("tokens"), "tokens")).alias("measure", "size"))
    stats = described(measures, [*by, "measure"], "size", {"p90": 0.9})
    columns = [F.max(F.when(F.col("measure") == m, F.floor(F.col(c)))).alias(f"{m}_{c}") for m in ("chars", "tokens") for c in ("least", "median", "p90", "most")]
    counts = sized.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(F.col("tokens") > limit).alias("over_limit"))
    return same_keys(counts, stats.groupBy(*by).agg(*columns), by)


def chunks_per_document(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*by, "document").agg(F.count("*").alias("chunks"))


def configuration_report(chunks: DataFrame, hits: DataFrame, scores: DataFrame, by: str, ks: Sequence[int], tokens: Column, limit: int) -> DataFrame:
    """Sizes, retrieval and separation of each chunk configuration.

    ``hits`` are (by, question, rank, hit) of the questions inside, ``scores``
    (by, question, score, inside) the best similarity of every question.
    """
    keyed = hits.withColumn("_question", F.struct(by, "question"))
    found = retrieval_by_question(keyed, "_question", ks).withColumn(by, F.col(f"_question.{by}"))
    quality = found.groupBy(by).agg(F.count("*").alias("questions"), *(F.round(F.avg(f"recall_{k}"), 3).alias(f"recall_{k}") for k in ks), F.round(F.avg("reciprocal_rank"), 3).alias("mrr"))
    out = same_keys(chunk_sizes(chunks, [by], tokens, limit), quality, [by])
    return same_keys(out, auc(scores, "score", "inside", by=[by]), [by])


def source_check(pages: DataFrame, least: int = 100, most_odd: float = 0.1) -> DataFrame:
    """Pages by verdict: empty, too short, illegible, usable."""
    odd = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{P}\s]", "")) / F.greatest(F.length("text"), F.lit(1))
    judged = pages.withColumn("verdict", legibility(F.length("text"), least, odd, most_odd))
    return judged.groupBy("document", "verdict").agg(F.count("*").alias("pages"))


def order_check(lines: DataFrame) -> DataFrame:
    return reading_order(lines, "document", "pos", "top")


def risk_report(processes: DataFrame, competitive: Sequence[str], least: int = 10, top: int = 20) -> dict[str, DataFrame]:
    """The single-bid indicator: steps, by department, by buyer, ties at the cut, effect of minimum sizes."""
    counted, steps = universe(processes, competitive)
    by_buyer = rate_by(counted, "buyer_id", "single_bid", ["buyer_name_clean", "department"], least)
    return {
        "steps": steps,
        "by_department": ranked(rate_by(counted, "department", "single_bid"), "department"),
        "by_buyer": ranked(by_buyer, "buyer_id", top),
        "ties": ties_at_cut(by_buyer, "buyer_id", top),
        "minimum_sizes": minimum_sizes(counted, "buyer_id", "single_bid"),
        "percentiles": size_percentiles(counted, "buyer_id"),
    }
