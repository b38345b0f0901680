"""Cross-site boilerplate removal by how many sites a line is spread over.

Per line hash, HyperLogLog sketches of the sites merge by aggregation (map
side first).  Lines whose estimate is near the threshold get an exact
distinct count; the others are decided by the estimate.  Boilerplate lines
are removed from every document that keeps a line of its own.  A document
of boilerplate lines alone is a copy rather than a page with furniture, so it
is left whole for document-level dedup.

Defined results: a line is compared without blanks at its ends and lines
without other characters are never boilerplate; a null source is a site of
its own; null text stays null and has no lines; very long texts are worked
on whole; rows equal in id and text get the same result; an empty table
gives no rows; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.scratch import stored

MIN_SITES = 10
SKETCH_LG = 10
#: Relative error that the exact count settles: over five standard errors of the sketch.
NEAR = 0.2


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) != ""


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes in ``lines`` (line, site) that stand on at least ``min_sites`` sites."""
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LG)).alias("sketch"), F.count("*").alias("n"))
    # fewer rows than the threshold cannot be that many sites
    guessed = stored(spread.filter(F.col("n") >= min_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    near = guessed.filter((F.col("sites") >= min_sites * (1 - NEAR)) & (F.col("sites") <= min_sites * (1 + NEAR)))
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    return guessed.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line").union(exact.filter(F.col("sites") >= min_sites).select("line"))


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """``line_row`` (the row as it was), the cleaned ``text``, ``n_lines`` and ``n_removed``."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _worded), _line_hash))
    lines = stored(docs.select(key.alias("line_key"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("site"), F.explode(hashes).alias("line")), "lines")
    spread = stored(boilerplate_lines(lines, min_sites), "boilerplate")
    marked = stored(lines.join(spread, "line").groupBy("line_key").agg(F.collect_set("line").alias("line_bad")), "lines-marked")
    # joined alike at every size
    packed = docs.select(F.struct(*docs.columns).alias("line_row"), key.alias("line_key")).join(marked.hint("merge"), "line_key", "left")
    is_bad = lambda x: F.array_contains("line_bad", _line_hash(x)) & _worded(x)
    text = F.col("line_row")["text"].cast("string")
    split = packed.withColumn("line_all", F.split(text, "\n")).withColumn("line_kept", F.when(F.col("line_bad").isNotNull(), F.filter("line_all", lambda x: ~is_bad(x))))
    split = split.withColumn("line_cut", F.coalesce(F.exists("line_kept", _worded), F.lit(False)))
    return split.select(
        "line_row",
        F.when(F.col("line_cut"), F.array_join("line_kept", "\n")).otherwise(text).alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size("line_all")).cast("long").alias("n_lines"),
        F.when(F.col("line_cut"), F.size("line_all") - F.size("line_kept")).otherwise(0).cast("long").alias("n_removed"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text."""
    return _cleaned(docs, min_sites).select(*(F.col("text") if c == "text" else F.col("line_row")[c].alias(c) for c in docs.columns))


def line_table(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Each document's lines, how many were removed, and its cleaned text."""
    return _cleaned(docs.select("doc_id", "text", "source"), min_sites).select(F.col("line_row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, row_number() OVER () AS rid, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, coalesce('=' || source, '') AS site, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT rid, source, unnest(ls) AS l FROM d)
), bad AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10
), parts AS (
  SELECT rid, p, l, trim(l, ' ' || chr(9) || chr(13)) IN (SELECT line FROM bad) AS is_bad
  FROM (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM d)
), cut AS (
  SELECT rid, count(*) FILTER (is_bad) AS n_bad, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT is_bad), '') AS kept,
    count(*) FILTER (NOT is_bad AND trim(l, ' ' || chr(9) || chr(13)) <> '') AS n_own FROM parts GROUP BY rid
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines,
  CASE WHEN n_own > 0 THEN n_bad ELSE 0 END AS n_removed,
  CASE WHEN n_bad > 0 AND n_own > 0 THEN kept ELSE text END AS text
FROM d LEFT JOIN cut USING (rid)
"""
