"""Structured filters: as conditions on tables, and their checking and combining on the driver."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

FIELDS = ("department", "category", "amount_min", "amount_max", "date_from", "date_to")


def conjunction(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def structured(wanted: Mapping[str, Any], columns: Mapping[str, str] | None = None, valid: Column | None = None) -> Column:
    """A filter's fields as one condition, which reaches the scan.

    ``columns`` names the columns for department, category, amount and day
    (a whole number YYYYMMDD).  Amount limits ask for a valid amount; rows
    without a value fail the limits on it.  ``departments`` and ``categories``
    are lists.
    """
    at = {"department": "department", "category": "category", "amount": "amount", "day": "day"} | dict(columns or {})
    parts = [F.col(at[k]) == wanted[k] for k in ("department", "category") if wanted.get(k)]
    parts += [F.col(at[k]).isin(list(wanted[many])) for k, many in (("department", "departments"), ("category", "categories")) if wanted.get(many)]
    if wanted.get("amount_min") is not None:
        parts.append(F.col(at["amount"]) >= wanted["amount_min"])
    if wanted.get("amount_max") is not None:
        parts.append(F.col(at["amount"]) <= wanted["amount_max"])
    if valid is not None and not {"amount_min", "amount_max"}.isdisjoint(k for k in wanted if wanted[k] is not None):
        parts.append(valid)
    as_number = lambda x: int(str(x).replace("-", ""))
    if wanted.get("date_from"):
        parts.append(F.col(at["day"]) >= as_number(wanted["date_from"]))
    if wanted.get("date_to"):
        parts.append(F.col(at["day"]) <= as_number(wanted["date_to"]))
    return conjunction(parts)


def by_words(text: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Any of the ``include`` patterns (all if empty) and none of ``exclude``."""
    any_of = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))
    condition = any_of(include) if include else F.lit(True)
    return condition & ~any_of(exclude) if exclude else condition


def _amount(value: Any) -> float | None:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return float(value) if number and value >= 0 else None


def _iso_day(text: str) -> str | None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return dt.date.fromisoformat(text).isoformat()
    except ValueError:
        return None


@dataclass(frozen=True)
class Rule:
    """How one field of a filter is read, and how two limits on it become one."""

    read: Callable[[Any], Any]
    tighter: Callable[[Iterable], Any] | None = None
    #: The field that lists several values for the same column.
    many: str | None = None


def rules(departments: Mapping[str, str], categories: Sequence[str], key: Callable[[str], str]) -> dict[str, Rule]:
    """The rule of every field; ``departments`` gives the shown name by ``key`` of what was written."""
    listed = {c: c for c in categories}
    return {
        "department": Rule(lambda x: departments.get(key(x)), many="departments"),
        "category": Rule(listed.get, many="categories"),
        "amount_min": Rule(_amount, max),
        "amount_max": Rule(_amount, min),
        "date_from": Rule(lambda x: _iso_day(str(x)), max),
        "date_to": Rule(lambda x: _iso_day(str(x)), min),
    }


RULES = rules({}, (), str)


def checked(raw: Mapping[str, Any], departments: Mapping[str, str], categories: Sequence[str], key: Any) -> tuple[dict, list[str]]:
    """The valid fields of an extracted filter, and a warning for each other one."""
    given = {field: raw[field] for field in FIELDS if raw.get(field) not in (None, "")}
    by = rules(departments, categories, key)
    read = {field: (value, by[field].read(value)) for field, value in given.items()}
    good = {field: got for field, (_, got) in read.items() if got is not None}
    return good, [f"{field} not recognised: {read[field][0]}" for field in read if field not in good]


def combined(asked: Mapping[str, Any], chosen: Mapping[str, Any]) -> tuple[dict, bool]:
    """Both filters at once, and whether they contradict each other in a listed field.

    Limits that cross are no contradiction; they just match nothing.
    """
    # every field as the set of values that both allow; None allows all
    wanted = {r.many: ({asked[f]} if asked.get(f) else None, list(chosen.get(r.many) or ())) for f, r in RULES.items() if r.many}
    contradiction = any(one and many and one.isdisjoint(many) for one, many in wanted.values())
    lists = {name: many for name, (one, many) in wanted.items() if many and not one}
    limits = {f: [x[f] for x in (asked, chosen) if x.get(f) is not None] for f, r in RULES.items() if r.tighter}
    return {**asked, **lists, **{f: RULES[f].tighter(x) for f, x in limits.items() if x}}, contradiction


def step_counts(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows left after each step of a chain of filters, counted in one pass."""
    so_far, counts = F.lit(True), [F.count("*").alias("all_rows")]
    for name, condition in steps.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    return df.agg(*counts)


def legibility(chars: Column, least: int, odd_share: Column, most_odd: float) -> Column:
    """Verdict on an extracted page."""
    return F.when(F.coalesce(chars, F.lit(0)) == 0, "empty").when(chars < least, "too short").when(odd_share > most_odd, "illegible").otherwise("usable")
