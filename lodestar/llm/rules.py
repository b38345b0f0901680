r"""Line-first quality rules, in DataFrame operations only.

Every line is judged by itself: punctuation (symbols for letters, shouting,
one word over and over), navigation (separator bars, short menu lines) and
boilerplate (notices that say nothing of the document).  Failing lines are
removed; a document that loses more than half of its words' characters that
way is rejected, as is one that fails the base rules.

Words are ``[^\x20\x09-\x0D]+``.  Defined results: null or empty text has no
words and fails the base; very long texts are judged whole; equal lines are
judged alike; repeated rows are judged each; an empty table gives no rows;
further columns stay in ``apply_rules`` and are ignored by ``rule_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MOST_LOST = 0.5
SYMBOL_SHARE = 0.1
CAPITAL_SHARE = 0.7
# fixed values: notices and menu entries, whole lines in lower case
BOILERPLATE = r"(?i)^\W*(all rights reserved|copyright\b.*|(this site uses|we use|accept( all)?) cookies\b.*|(terms of (use|service)|privacy policy)\b.{0,40}|subscribe to our newsletter\b.*|follow us on\b.{0,60})\W*$"
NAVIGATION = r"(?i)^\W*(home|menu|login|log in|sign up|sign in|next|previous|back to top|read more|click here|share|search|skip to content)\W*$"


def _without(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, "[" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]+", "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def measured(lines: Column) -> Column:
    """Each line with its counts, in two steps so that each pattern runs over a line once."""
    looked = F.transform(lines, lambda x: F.struct(x.alias("line"), _without(x, SPACE_CHARS).alias("dense"), F.regexp_replace(x, r"[^\p{L}]+", "").alias("letters")))
    return F.transform(
        looked,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.length(x["dense"]).alias("chars"),
            F.length(_without(x["dense"], SYMBOLS)).alias("no_symbols"),
            F.length(x["letters"]).alias("letters"),
            F.length(F.regexp_replace(x["letters"], r"\p{Lu}+", "")).alias("small"),
        ),
    )


def passes(x: Column) -> Column:
    """Whether a measured line stands all three kinds of rules."""
    line = x["line"]
    symbols = x["chars"] - x["no_symbols"] > SYMBOL_SHARE * x["chars"]
    shouting = (x["letters"] >= 8) & (x["letters"] - x["small"] > CAPITAL_SHARE * x["letters"])
    bars = F.length(line) - F.length(F.replace(line, F.lit(" | "), F.lit("  "))) >= 3
    stuttering = F.length(line) - F.length(F.regexp_replace(line, r"(?<!\S)(\S+)(?: \1(?!\S))+", "")) > 0.5 * F.length(line)
    return ~(symbols | shouting | bars | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE) | stuttering)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the line verdict, step by step so that each array is made once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.withColumn("rule_text", text)
    step = step.withColumns({"rule_words": words_of(F.col("rule_text")), "rule_lines": F.filter(F.split("rule_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    window = lambda i: F.xxhash64(*(F.get("rule_words", i + j) for j in range(5)))
    n = F.size("rule_words")
    step = step.withColumn("rule_windows", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.expr("cast(array() as array<bigint>)")))
    step = step.withColumn(
        "rule_sorted",
        F.when(
            F.size(F.array_distinct("rule_windows")) < F.size("rule_windows"),
            F.array_sort(F.transform("rule_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ranked = F.col("rule_sorted")
    twice = F.filter(ranked, lambda x, j: F.coalesce(F.get(ranked, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, j + 1)["h"] == x["h"], F.lit(False)))
    step = step.withColumn("rule_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    starts = F.col("rule_starts")
    gaps = F.transform(starts, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(starts, j + 1) - p, F.lit(5))))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    step = step.withColumns({"n_repeat_words": repeated, "rule_kept": F.filter(measured(F.col("rule_lines")), passes)})
    word_chars = F.length(_without(F.col("rule_text"), SPACE_CHARS))
    return step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": word_chars.cast("long"),
            "n_symbols": (F.length("rule_text") - F.length(_without(F.col("rule_text"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("rule_lines") - F.size(F.array_distinct("rule_lines"))).cast("long"),
            "n_lines_removed": (F.size("rule_lines") - F.size("rule_kept")).cast("long"),
            "kept_chars": F.aggregate("rule_kept", F.lit(0).cast("long"), lambda n, x: n + x["chars"]),
        }
    )


def _verdict(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= (1 - MOST_LOST) * F.col("word_chars")))


def rule_table(docs: DataFrame) -> DataFrame:
    """Each document's base counts, its lines removed, and whether it is kept."""
    out = _verdict(_counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "kept_chars")


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that are kept, their failing lines removed from the text."""
    packed = docs.select(F.struct(*docs.columns).alias("rule_row"), F.col("text").alias("text"))
    kept = _verdict(_counted(packed)).filter("kept")
    return kept.select(*(F.array_join(F.transform("rule_kept", lambda x: x["line"]), "\n").alias(c) if c == "text" else F.col("rule_row")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i:i + 4] AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY rid
), lines AS (
  SELECT rid, l, regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') AS dense, regexp_replace(l, '[^\p{L}]+', '', 'g') AS letters FROM (SELECT rid, unnest(ls) AS l FROM w)
), stutter AS (
  SELECT rid, l, sum(n) AS lost FROM (
    SELECT rid, l, g, count(*) AS c, sum(length(x)) + count(*) - 1 AS n FROM (
      SELECT rid, l, x, p, sum(new) OVER (PARTITION BY rid, l ORDER BY p) AS g FROM (
        SELECT rid, l, x, p, CASE WHEN x = lag(x) OVER (PARTITION BY rid, l ORDER BY p) THEN 0 ELSE 1 END AS new FROM (
          SELECT rid, l, unnest(string_split(l, ' ')) AS x, generate_subscripts(string_split(l, ' '), 1) AS p FROM (SELECT DISTINCT rid, l FROM lines)))) GROUP BY rid, l, g)
  WHERE c > 1 GROUP BY rid, l
), judged AS (
  SELECT a.rid, dense, NOT (
      length(dense) - length(regexp_replace(dense, '[#*$%&|<>]+', '', 'g')) > 0.1 * length(dense)
      OR (length(letters) >= 8 AND length(letters) - length(regexp_replace(letters, '\p{Lu}+', '', 'g')) > 0.7 * length(letters))
      OR coalesce(lost, 0) > 0.5 * length(a.l)
      OR length(a.l) - length(replace(a.l, ' | ', '  ')) >= 3
      OR regexp_matches(a.l, '(?i)^\W*(home|menu|login|log in|sign up|sign in|next|previous|back to top|read more|click here|share|search|skip to content)\W*$')
      OR regexp_matches(a.l, '(?i)^\W*(all rights reserved|copyright\b.*|(this site uses|we use|accept( all)?) cookies\b.*|(terms of (use|service)|privacy policy)\b.{0,40}|subscribe to our newsletter\b.*|follow us on\b.{0,60})\W*$')
    ) AS ok
  FROM lines a LEFT JOIN stutter s ON a.rid = s.rid AND a.l = s.l
), kept AS (
  SELECT rid, count(*) FILTER (NOT ok) AS removed, coalesce(sum(length(dense)) FILTER (ok), 0) AS chars FROM judged GROUP BY rid
), counts AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS n_lines_removed, CAST(coalesce(chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN kept USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5 * word_chars AS kept
FROM counts
"""
