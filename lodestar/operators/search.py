"""Similarity search under structured filters, with a threshold for abstaining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators.nearest import nearest_per_query, nearest_to


def top_k(corpus: DataFrame, vector: list[float], k: int, where: Column | None = None, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` most similar rows that meet ``where``; vectors have length 1.

    The filter stands below the scores, so it reaches the scan, and each task
    keeps its own k before they meet.
    """
    return nearest_to(corpus if where is None else corpus.filter(where), vector, k, id_column, vector_column)


def top_k_per_query(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every query (query_id, vector), with their rank; exact."""
    return nearest_per_query(corpus, queries, k, query_id, id_column, vector_column)


def gated(hits: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Best similarity (to four places) and whether it passes; one row, or one for each ``by``."""
    best = F.coalesce(F.round(F.max("similarity"), 4), F.lit(0.0))
    grouped = hits.groupBy(*by) if by else hits
    return grouped.agg(F.count("*").alias("hits"), best.alias("best")).withColumn("passes", F.col("best") >= threshold)


def sources_listed(hits: DataFrame, line: Column, order: str = "rank") -> DataFrame:
    """One text of all hits in order, each headed by its number."""
    numbered = hits.select(F.col(order).alias("n"), F.concat(F.lit("[F"), F.col(order).cast("string"), F.lit("] "), line).alias("line"))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("listing"))
