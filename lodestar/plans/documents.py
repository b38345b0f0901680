"""Cleaning and chunking of paged documents, the page number never lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from lodestar.functions.text import ligatures_joined, removed
from lodestar.operators.chunks import chunked, pages_of_paragraphs, paragraphs, with_metadata
from lodestar.operators.versions import entries, resolved, standing

# fixed values: page furniture of the gazette and of the consolidated edition
FURNITURE = {
    "header": r"\A\s*(\d{1,3}\s*\n)?\s*NORMAS\s+LEGALES\s*\n[^\n]*\d{4}\s*\n\s*El Peruano\s*(/\s*)?\n(\s*/\s*\n)?",
    "signature": r"Firmado por:\s*Editora Peru\s*\n\s*Fecha:\s*[\d/]+\s+[\d:]+\s*\n?",
    "publication_code": r"(?m)^\s*\d{7}-\d+\s*$",
}
DROPPED_PARAGRAPHS = r"^CONCORDANCIAS:"


def noise_out(pages: DataFrame, furniture: Mapping[str, str] = FURNITURE) -> DataFrame:
    """Furniture out and ligatures joined; the hits of each rule stand in ``hits``."""
    text, hits = removed(F.col("text"), furniture)
    text, ligatures = ligatures_joined(text)
    counts = F.struct(*(c.alias(name) for name, c in hits.items()), ligatures.alias("ligatures"))
    return pages.select("document", "page", text.alias("text"), counts.alias("hits"))


def rule_counts(noise: DataFrame) -> DataFrame:
    names = noise.schema["hits"].dataType.names
    return noise.groupBy("document").agg(*(F.sum(f"hits.{n}").alias(n) for n in names))


def clean_paragraphs(pages: DataFrame, with_notes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(paragraphs to keep, resolved paragraphs of the documents with notes, for their register)."""
    quiet = noise_out(pages).drop("hits")
    noted = F.col("document").isin(list(with_notes))
    wanted = lambda df: df.filter(~F.col("text").rlike(DROPPED_PARAGRAPHS))
    plain = wanted(paragraphs(quiet.filter(~noted), blank_lines=False))
    rows = resolved(wanted(paragraphs(quiet.filter(noted), blank_lines=True))).persist()
    return plain.unionByName(standing(rows).select(*plain.columns)), rows


def clean_documents(pages: DataFrame, with_notes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean pages, register of version notes)."""
    kept, rows = clean_paragraphs(pages, with_notes)
    return pages_of_paragraphs(kept), entries(rows)


def chunk_documents(pages: DataFrame, catalogue: DataFrame, size: int = 500, overlap: int = 150) -> DataFrame:
    return with_metadata(chunked(pages, size, overlap), catalogue)
