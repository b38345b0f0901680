"""Text columns: comparison keys, repair, masking, patterns and lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T



def _folded(first: int, last: int) -> dict[str, str]:
    """Capitals of a range that decompose into one plain character, and that character."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(first, last + 1)}
    return {c: p.upper() for c, p in plain.items() if len(p.upper()) == 1 and p.upper() != c}


#: Latin, Greek, Cyrillic, further Latin and Greek, and full-width letters.
FOLDED = {c: p for span in ((0xAA, 0x52F), (0x1E00, 0x1FFF), (0xFF01, 0xFF5E)) for c, p in _folded(*span).items()}
MARKED, PLAIN = "".join(FOLDED), "".join(FOLDED.values())
# fixed values: Unicode's white space
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}


def squeeze(text: Column) -> Column:
    """Runs of white space (Unicode's too) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def accent_key(text: Column) -> Column:
    """Comparison key without marks, case and extra blanks; null gives the empty key.

    Built-in functions only: marks that stand alone are taken out, letters with
    marks are looked up in ``FOLDED``; ``accent_key_full`` covers what else
    Unicode decomposes (ligatures, fractions, other scripts).  Texts of ASCII
    alone have nothing to look up.
    """
    upper = F.upper(F.coalesce(text.cast("string"), F.lit("")))
    folded = F.translate(F.regexp_replace(upper, r"\p{Mn}+", ""), MARKED, PLAIN)
    return squeeze(F.when(upper.rlike(r"[^\x00-\x7F]"), folded).otherwise(upper))


def accent_key_full(text: Column) -> Column:
    """``accent_key`` by full decomposition, for letters beyond ``FOLDED``."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        parts = column.fillna("").astype(str).str.normalize("NFKD").map(lambda s: "".join(c for c in s if not unicodedata.combining(c)))
        return parts.str.upper().str.split().str.join(" ")

    return run(text)


def literal_newlines_out(text: Column) -> Column:
    r"""A written-out ``\n`` becomes a blank."""
    return squeeze(F.replace(text, F.lit("\\n"), F.lit(" ")))


def lost_quotes(text: Column) -> Column:
    """Whether ``¿`` stands for lost quotation marks: there is one, and no ``?``."""
    return text.contains("¿") & ~text.contains("?")


def mojibake(text: Column) -> Column:
    return text.rlike("Ã|Â|�")


def repaired(text: Column) -> Column:
    """Lost quotes put back and stray ``Â`` taken out."""
    quoted = F.when(lost_quotes(text), F.replace(text, F.lit("¿"), F.lit('"'))).otherwise(text)
    return F.when(mojibake(quoted), squeeze(F.replace(quoted, F.lit("Â"), F.lit("")))).otherwise(quoted)


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank, else the first."""
    return reduce(lambda rest, text: F.when(~blank(text), text).otherwise(rest), reversed(texts), texts[0])


def is_short(text: Column, least: int) -> Column:
    return ~blank(text) & (F.length(text) < least)


def content_hash(text: Column, chars: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, chars)


def record_hash(text: Column, metadata: Mapping[str, Column], chars: int = 16) -> Column:
    """Hash of a text with its metadata, keys in order."""
    fields = F.struct(*(metadata[k].alias(k) for k in sorted(metadata)))
    return F.substring(F.sha1(F.concat(text, F.to_json(fields, {"ignoreNullFields": "false"}))), 1, chars)


def mask_secrets(text: Column, most: int = 200) -> Column:
    """API keys out of an error message, which is cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"sk-[A-Za-z0-9*_\-]+", "sk-[hidden]"), 1, most)


def removed(text: Column, patterns: Mapping[str, str]) -> tuple[Column, dict[str, Column]]:
    """The text without all matches of the patterns in turn, and the hits of each."""
    hits = {}
    for name, pattern in patterns.items():
        hits[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, "")
    return text, hits


def ligatures_joined(text: Column, table: Mapping[str, str] = LIGATURES) -> tuple[Column, Column]:
    """Ligatures written out, together with the blank that follows them inside a word; and their number."""
    n = sum((F.regexp_count(text, F.lit(f"{bad}\\s*(?=[a-záéíóúñ])")) for bad in table), F.lit(0))
    for bad, good in table.items():
        text = F.replace(F.regexp_replace(text, f"{bad}\\s*(?=[a-záéíóúñ])", good), F.lit(bad), F.lit(good))
    return text, n


def joined_lines(lines: Column) -> Column:
    """Lines of a paragraph as one; a line that ends in a hyphen takes the next without a blank."""
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    glue = lambda out, x: F.when((out == "") | out.endswith("-"), F.concat(out, x)).otherwise(F.concat(out, F.lit(" "), x))
    return squeeze(F.aggregate(trimmed, F.lit(""), glue))


def pages_of(spec: Column) -> Column:
    """``doc:1,2;doc:3`` as an array of (document, page)."""
    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), ";"), lambda x: x.contains(":"))
    pairs = F.transform(
        parts,
        lambda p: F.transform(
            F.split(F.get(F.split(p, ":"), 1), ","),
            lambda n: F.struct(F.trim(F.get(F.split(p, ":"), 0)).alias("document"), n.try_cast("int").alias("page")),
        ),
    )
    return F.array_distinct(F.flatten(pairs))


def sorted_join(values: Column, separator: str = "|") -> Column:
    """Distinct values in order, joined; nulls are left out."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), separator)


def first_join(values: Column, n: int = 5, separator: str = " | ") -> Column:
    return F.array_join(F.transform(F.slice(values, 1, n), lambda x: F.coalesce(x, F.lit(""))), separator)


def holds_any(text: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in needles), F.lit(False))


def numbers_cited(text: Column) -> Column:
    """The numbers in ``[F1]``-like marks, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[F(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def citations_set(text: Column, labels: Column) -> Column:
    """``[Fn]`` replaced by the n-th label; marks of no source go, as do blanks before punctuation."""
    put = lambda out, n: F.replace(out, F.concat(F.lit("[F"), n.cast("string"), F.lit("]")), F.coalesce(F.get(labels, n - 1), F.lit("")))
    marked = F.aggregate(F.array_distinct(numbers_cited(text)), text, put)
    return F.trim(F.regexp_replace(marked, r"\s+([.,;:])", "$1"))


def ids_in(text: Column, pattern: str) -> Column:
    """All matches of an id pattern, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def ids_masked(text: Column, cited: Column, known: Column, mask: str) -> Column:
    """Ids that were not retrieved are shown as ``mask``."""
    return F.aggregate(F.array_except(cited, known), text, lambda out, x: F.replace(out, x, F.lit(mask)))


def money(amount: Column, valid: Column, currency: str = "S/", missing: str = "no published amount") -> Column:
    return F.when(valid, F.concat(F.lit(f"{currency} "), F.format_number(amount, 2))).otherwise(missing)


def day(date_int: Column, missing: str = "no date") -> Column:
    shown = F.date_format(F.try_to_date(date_int.cast("string"), "yyyyMMdd"), "yyyy-MM-dd")
    return F.coalesce(F.when(date_int > 0, shown), F.lit(missing))
