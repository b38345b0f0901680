"""Reading and writing of tables: Parquet, JSON lines, JSON documents, CSV, YAML-like settings, logs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, is_dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from lodestar.schemas import CALL_LOG, PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON line per page."""
    return spark.read.schema(PAGE).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quoted fields may hold commas, quotes and line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A download is one file; anything larger stays in as many as it has partitions."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON document."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))


def relevance(spark: SparkSession, path: str) -> DataFrame:
    """``{question: [ids]}`` as one row per pair."""
    table = spark.read.schema("value string").text(path, wholetext=True)
    return table.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("question", "ids")).select("question", F.explode("ids").alias("id"))


def append_calls(spark: SparkSession, path: str, calls: list[Mapping[str, Any]]) -> None:
    """Rows added to the call log; a log that is not there yet begins with its schema."""
    order = [part.split(" ")[0] for part in CALL_LOG.split(", ")]
    spark.createDataFrame([tuple(c.get(k) for k in order) for c in calls], CALL_LOG).write.mode("append").parquet(path)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_LOG).parquet(path)


def append_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Lines added to a text log, each headed by the time (UTC) and its number in the call, line ends as blanks; nothing to add, no file."""
    at = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    rows = [(f"{at} {i:04d} {' '.join(line.splitlines())}",) for i, line in enumerate(lines)]
    if rows:
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line) of a text log; ``at`` orders the lines."""
    parts = F.split("value", " ", 3)
    return spark.read.text(path).select(F.concat_ws(" ", parts[0], parts[1]).alias("at"), parts[2].alias("line"))


def settings(kind: type, values: Mapping[str, Any]) -> Any:
    """A settings dataclass from nested mappings; unknown names are errors, defaults fill the rest."""
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    inner = lambda f, v: settings(f.type, v) if isinstance(f.type, type) and is_dataclass(f.type) and isinstance(v, Mapping) else v
    return kind(**{name: inner(known[name], value) for name, value in values.items()})


def load_settings(kind: type, path: str | Path) -> Any:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return settings(kind, json.loads(text))
    import yaml

    return settings(kind, yaml.safe_load(text))


@dataclass(frozen=True)
class Definition:
    """One gold question: its filters and the words that make a row relevant."""

    id: str
    question: str
    filters: Mapping[str, Any]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    note: str = ""


def definitions_table(spark: SparkSession, definitions: list[Definition]) -> DataFrame:
    rows = [(d.id, d.question, json.dumps(dict(d.filters), sort_keys=True), list(d.include), list(d.exclude), d.note) for d in definitions]
    return spark.createDataFrame(rows, "id string, question string, filters string, include array<string>, exclude array<string>, note string")


def markdown_table(rows: list[Row]) -> str:
    """A small collected table as Markdown."""
    if not rows:
        return ""
    names = list(rows[0].asDict())
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)]
    return "\n".join(lines)


def feature_collection(features: list[str]) -> str:
    """GeoJSON features (as JSON) in one document."""
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(f) for f in features]}, ensure_ascii=False)
