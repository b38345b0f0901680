"""From raw documents to packed training sequences.

Each stage is one operator on all that the stage before kept, written as
Parquet and read again:

1. quality classifier: documents that it rejects go;
2. line dedup: boilerplate lines that are spread over many sites go;
3. MinHash near-dedup (five-word shingles, similarity 0.8): one document of
   each class stays;
4. mixing sources to target weights: documents repeat or go as the mix says;
5. packing: token pieces in sequences of at most 1024.

All stages but the last return the columns of ``documents``.  The classifier
and the tokenizer cannot be expressed in SQL, so there is no oracle; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.lines import remove_boilerplate
from lodestar.llm.mixing import apply_mix
from lodestar.llm.neardup import near_dup_kept
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import accepted_documents
from lodestar.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_boilerplate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup_kept(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}")
    return docs
