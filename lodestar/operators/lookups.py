"""Joins with dimensions: lookups with a default, cascades, filling from the same entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def mapped(df: DataFrame, key: Column, pairs: DataFrame, output: str, default: str | None = None) -> DataFrame:
    """``df`` with the value that ``pairs`` (key, value) has for ``key``; its size decides how it is joined."""
    table = pairs.select(F.col(pairs.columns[0]).alias("_key"), F.col(pairs.columns[1]).alias("_value"))
    joined = df.withColumn("_look", key).join(table, F.col("_look") == F.col("_key"), "left")
    value = F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")
    return joined.withColumn(output, value).drop("_look", "_key", "_value")


def cascade(df: DataFrame, steps: Sequence[tuple[str, Column, DataFrame]], output: str) -> DataFrame:
    """The value of the first step that has one, and that step's name in ``<output>_source``."""
    names = []
    for name, key, pairs in steps:
        df = mapped(df, key, pairs, f"_{name}")
        names.append(name)
    source = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), n) for n in names), F.lit(""))
    return df.withColumns({output: F.coalesce(*(F.col(f"_{n}") for n in names)), f"{output}_source": source}).drop(*(f"_{n}" for n in names))


def aliased(key: Column, aliases: dict[str, str]) -> Column:
    """A key or what it is an alias of."""
    for name, target in aliases.items():
        key = F.when(key == name, target).otherwise(key)
    return key


def mode_of(df: DataFrame, by: str, value: str, output: str) -> DataFrame:
    """Most frequent value of each ``by``; the smallest on a tie."""
    return df.filter(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.mode(value, True).alias(output))


def filled_by_mode(df: DataFrame, by: str, value: str) -> DataFrame:
    """Missing values taken from the mode of the same ``by``; ``<value>_source`` says so."""
    known = mode_of(df, by, value, "_mode").withColumnRenamed(by, "_by")
    joined = df.join(known, F.col(by) == F.col("_by"), "left")
    filled = F.col(value).isNull() & F.col("_mode").isNotNull()
    old = F.col(f"{value}_source") if f"{value}_source" in df.columns else F.when(F.col(value).isNotNull(), "own").otherwise("")
    return joined.withColumns({f"{value}_source": F.when(filled, "same entity").otherwise(old), value: F.coalesce(value, "_mode")}).drop("_by", "_mode")


def spelling_variants(df: DataFrame, raw: str, key: Column) -> DataFrame:
    """Keys that are written in more than one way."""
    return df.filter(F.col(raw).isNotNull()).groupBy(key.alias("key")).agg(F.count_distinct(raw).alias("spellings")).filter("spellings > 1")


def over_dimension(dimension: DataFrame, facts: DataFrame, on: str, zeros: Sequence[str]) -> DataFrame:
    """Every row of the dimension, with 0 where the facts have none."""
    return dimension.join(facts, on, "left").fillna(0, subset=list(zeros))


def priced(calls: DataFrame, bands: DataFrame, model: str, time: Column) -> DataFrame:
    """Calls with the tariff band of their model whose ``[from_time, to_time)`` holds their local time."""
    timed = calls.withColumn("_time", time)
    table = bands.withColumnRenamed("model", "_model")
    within = (F.col(model) == F.col("_model")) & (F.col("_time") >= F.col("from_time")) & ((F.col("to_time") == "24:00") | (F.col("_time") < F.col("to_time")))
    return timed.join(table, within, "left").drop("_model", "_time")


def call_cost(tokens_in: Column, tokens_cached: Column, tokens_out: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """Prices are per million tokens; cached tokens have their own."""
    return ((tokens_in - tokens_cached) * price_in + tokens_cached * price_cached + tokens_out * price_out) / 1_000_000
