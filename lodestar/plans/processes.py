"""From nested source records to validated processes, with a report of every rule.

No row is deleted: each problem is marked, repaired where it can be, and
counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.functions.dates import utc_timestamp
from lodestar.functions.text import accent_key, blank, first_join, is_short, literal_newlines_out, lost_quotes, mojibake, repaired, sorted_join, squeeze
from lodestar.operators.dedupe import changed_versions, latest_per_key, values_per_key, with_version_kinds
from lodestar.operators.lookups import aliased, cascade, filled_by_mode, mapped, spelling_variants
from lodestar.operators.quantiles import same_keys
from lodestar.schemas import PROCESS, fields
from lodestar.sources.tables import kept


def _first(array: Column, condition) -> Column:
    return F.get(F.filter(array, condition), 0)


def flattened(records: DataFrame, file_month: Column) -> DataFrame:
    """One flat row per nested record; missing branches give nulls, missing lists count 0."""
    c, t = F.col("compiledRelease"), F.col("compiledRelease.tender")
    buyer = F.coalesce(
        _first(c["parties"], lambda p: F.array_contains(F.coalesce(p["roles"], F.array().cast("array<string>")), "buyer")),
        _first(c["parties"], lambda p: p["id"] == c["buyer"]["id"]),
    )
    # found once for the four columns that read it
    records, buyer = records.withColumn("_buyer", buyer), F.col("_buyer")
    n = lambda array: F.coalesce(F.size(array), F.lit(0))
    size = lambda array: F.when(array.isNull(), 0).otherwise(n(array))
    suppliers = F.array_distinct(F.filter(F.flatten(F.transform(c["awards"], lambda a: F.transform(F.coalesce(a["suppliers"], F.expr("cast(array() as array<struct<id:string>>)")), lambda s: s["id"]))), lambda x: x.isNotNull()))
    awarded = F.aggregate(c["awards"], F.lit(0.0), lambda total, a: total + F.coalesce(a["value"]["amount"], F.lit(0.0)))
    columns = {
        "ocid": F.coalesce("ocid", c["ocid"]),
        "file_month": file_month,
        "segment": c["dataSegmentation"]["id"],
        "compiled_at": c["date"],
        "n_releases": size(F.col("releases")),
        "last_release_at": F.array_max(F.transform("releases", lambda r: r["date"])),
        "tender_id": t["id"],
        "title": t["title"],
        "description": t["description"],
        "method": t["procurementMethodDetails"],
        "category": t["mainProcurementCategory"],
        "amount": t["value"]["amount"],
        "currency": t["value"]["currency"],
        "amount_local": t["value"]["amount_PEN"],
        "published_at": t["datePublished"],
        "opened_at": t["tenderPeriod"]["startDate"],
        "buyer_id": c["buyer"]["id"],
        "buyer_name": c["buyer"]["name"],
        "buyer_tax_id": _first(buyer["additionalIdentifiers"], lambda a: a["scheme"] == "PE-RUC")["id"],
        "buyer_department": buyer["address"]["department"],
        "buyer_region": buyer["address"]["region"],
        "buyer_locality": buyer["address"]["locality"],
        "n_bidders": t["numberOfTenderers"],
        "n_bidders_listed": size(t["tenderers"]),
        "n_items": size(t["items"]),
        "item_states": F.coalesce(sorted_join(F.transform(t["items"], lambda i: i["statusDetails"])), F.lit("")),
        "item_descriptions": F.coalesce(first_join(F.transform(t["items"], lambda i: i["description"])), F.lit("")),
        "item_classes": F.coalesce(F.substring(sorted_join(F.transform(t["items"], lambda i: i["classification"]["id"])), 1, 300), F.lit("")),
        "n_awards": size(c["awards"]),
        "awarded_amount": F.when(size(c["awards"]) > 0, awarded),
        "n_suppliers": F.coalesce(F.when(c["awards"].isNotNull(), F.size(suppliers)), F.lit(0)),
    }
    return records.select(*(columns[name].cast(kind).alias(name) for name, kind in fields(PROCESS)))


def one_row_per_process(files: Sequence[DataFrame]) -> DataFrame:
    """All files together, the latest row of each process, with the months it appears in."""
    union = files[0]
    for other in files[1:]:
        union = union.unionByName(other)
    newest = [F.desc_nulls_last("compiled_at"), F.desc("n_releases"), F.desc("file_month"), F.asc_nulls_last("tender_id")]
    return latest_per_key(union, ["ocid"], newest).join(values_per_key(union, "ocid", "file_month", "months"), "ocid")


def acquisition_report(union: DataFrame, watched: Sequence[str] = ("amount", "item_states", "n_bidders")) -> DataFrame:
    """Rows before, processes, repeated rows, processes that changed between files."""
    changed = changed_versions(union, "ocid", watched).agg(F.count("*").alias("changed"))
    return union.agg(F.count("*").alias("rows"), F.count_distinct("ocid").alias("processes")).withColumn("repeated", F.col("rows") - F.col("processes")).join(F.broadcast(changed))


@dataclass(frozen=True)
class Rules:
    """What validation is told: words, limits and the small territory tables (key, department)."""

    departments: DataFrame
    provinces: DataFrame
    unique_districts: DataFrame
    province_aliases: Mapping[str, str]
    categories: Mapping[str, str]
    failed_states: Sequence[str]
    local_currency: str = "PEN"
    no_category: str = "Sin categoría"
    least_description: int = 15


def _warned(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(c, text) for c, text in rules)))
    return df.withColumn("warnings", F.concat("warnings", found))


def with_basics(df: DataFrame, rules: Rules) -> DataFrame:
    categories = df.sparkSession.createDataFrame(list(rules.categories.items()), "key string, name string")
    named = mapped(df, F.col("category"), categories, "category_name", rules.no_category)
    return named.withColumns(
        {
            "published": utc_timestamp(F.col("published_at")),
            "month": F.coalesce("segment", "file_month"),
            "warnings": F.expr("cast(array() as array<string>)"),
            "in_analysis": F.lit(True),
            "excluded_because": F.lit(""),
        }
    )


def with_repeats(df: DataFrame, rules: Rules) -> DataFrame:
    """Rules 1b and 1c: one tender under two ids; one title of one buyer again."""
    newest = [F.desc_nulls_last("compiled_at"), F.desc("n_releases"), F.asc("ocid")]
    # processes without a tender are no group, so each is a partition of its own
    by_tender = W.partitionBy(F.coalesce(F.col("tender_id"), F.concat(F.lit("\u0000"), "ocid")))
    df = df.withColumns({"_tender_n": F.count("*").over(by_tender), "_tender_at": F.row_number().over(by_tender.orderBy(*newest))})
    copy = F.col("tender_id").isNotNull() & (F.col("_tender_n") > 1) & (F.col("_tender_at") > 1)
    df = df.withColumns({"in_analysis": ~copy, "excluded_because": F.when(copy, "same tender under another id").otherwise("")})
    failed = F.lit(False)
    for state in rules.failed_states:
        failed = failed | F.coalesce(F.col("item_states").contains(state), F.lit(False))
    in_time = [F.asc_nulls_last("published"), F.asc_nulls_last("compiled_at"), F.asc("ocid")]
    df = with_version_kinds(df, ["buyer_id", "title"], "ocid", in_time, failed, F.to_date("published"), F.col("description"))
    # the same day and description again inside a group is the same process counted twice
    eligible = (F.col("version_kind") != "") & F.col("in_analysis")
    same_day = W.partitionBy("buyer_id", "title", "_apart", F.to_date("published"), "description", F.when(~eligible, F.col("ocid"))).orderBy(*newest)
    again = eligible & (F.row_number().over(same_day) > 1)
    df = df.withColumn("_again", again)
    df = df.withColumns({"in_analysis": F.col("in_analysis") & ~F.col("_again"), "excluded_because": F.when(F.col("_again"), "registered again on the same day").otherwise(F.col("excluded_because"))})
    return _warned(df, (F.col("version_kind") != "", "possible repeat of an earlier call")).drop("_tender_n", "_tender_at", "_apart", "_again")


def with_amounts(df: DataFrame, rules: Rules) -> DataFrame:
    """Rule 2: the published conversion if there is one, else a local amount, else what was awarded."""
    local = F.coalesce("currency", F.lit(rules.local_currency)) == rules.local_currency
    called = F.when(F.col("amount_local") > 0, F.col("amount_local")).when(local, F.col("amount"))
    rescued = (F.coalesce(called, F.lit(0.0)) == 0) & (F.coalesce("awarded_amount", F.lit(0.0)) > 0) & local
    df = df.withColumn("_called", called).withColumn("_rescued", rescued)
    source = F.when(F.col("_rescued"), "awarded").when(F.col("_called") > 0, "called").otherwise("")
    df = df.withColumns({"amount_source": source, "amount_local": F.when(F.col("_rescued"), F.col("awarded_amount")).otherwise(F.col("_called")), "amount_missing": F.coalesce("_called", F.lit(0.0)) == 0})
    df = df.withColumn("amount_valid", F.coalesce("amount_local", F.lit(0.0)) > 0)
    return _warned(df, (~F.col("amount_valid"), "no amount: left out of sums, counted as a process")).drop("_called", "_rescued")


def with_descriptions(df: DataFrame, rules: Rules) -> DataFrame:
    """Rules 3 and 4: an empty description from the items; encoding and blanks repaired."""
    own = literal_newlines_out(F.coalesce("description", F.lit("")))
    df = df.withColumn("_own", own)
    empty, rescued = blank(F.col("_own")), blank(F.col("_own")) & ~blank(F.col("item_descriptions"))
    chosen = F.when(rescued, F.col("item_descriptions")).otherwise(F.col("_own"))
    df = df.withColumns(
        {
            "description_empty": empty,
            "description_rescued": rescued,
            "description_short": is_short(F.col("_own"), rules.least_description),
            "quotes_lost": lost_quotes(chosen),
            "mojibake": mojibake(chosen),
            "description_clean": repaired(chosen),
            "buyer_name_clean": squeeze(F.col("buyer_name")),
        }
    )
    return _warned(df, (empty & ~rescued, "no description: not indexed"), (F.col("description_short"), "very short description")).drop("_own")


def with_location(df: DataFrame, rules: Rules) -> DataFrame:
    """Rule 5: department as declared, else by province (with aliases), unique district, the same buyer elsewhere."""
    province = aliased(accent_key(F.col("buyer_region")), {accent_key_of(k): accent_key_of(v) for k, v in rules.province_aliases.items()})
    steps = [("declared", accent_key(F.col("buyer_department")), rules.departments), ("province", province, rules.provinces), ("district", accent_key(F.col("buyer_locality")), rules.unique_districts)]
    placed = cascade(df, steps, "department")
    by_province = mapped(placed, province, rules.provinces, "_by_province")
    off = (F.col("department_source") == "declared") & F.col("_by_province").isNotNull() & (F.col("_by_province") != F.col("department"))
    by_province = by_province.withColumns({"location_off": off, "province": F.when(F.col("_by_province").isNotNull(), province)})
    filled = filled_by_mode(by_province.drop("_by_province"), "buyer_id", "department")
    return _warned(filled, (F.col("location_off"), "declared department is not the province's"), (F.col("department").isNull(), "no department"))


def accent_key_of(text: str) -> str:
    """The driver's side of ``accent_key`` for small tables."""
    from lodestar.functions.text import MARKED, PLAIN

    return " ".join(text.upper().translate(str.maketrans(MARKED, PLAIN)).split())


def validated(processes: DataFrame, rules: Rules) -> DataFrame:
    """All rules in turn; as many rows as before.

    The rows are written once before: filling from the same buyer reads them twice.
    """
    out = with_basics(kept(processes, "processes"), rules)
    for rule in (with_repeats, with_amounts, with_descriptions, with_location):
        out = rule(out, rules)
    return out.withColumn("n_warnings", F.size("warnings"))


def quality_report(valid: DataFrame) -> DataFrame:
    """Counts and rates of every rule, in one pass."""
    flags = {
        "excluded_same_tender": F.col("excluded_because") == "same tender under another id",
        "excluded_same_day": F.col("excluded_because") == "registered again on the same day",
        "not_current": ~F.col("is_current"),
        "amount_missing": F.col("amount_missing"),
        "amount_rescued": F.col("amount_source") == "awarded",
        "amount_invalid": ~F.col("amount_valid"),
        "foreign_currency": F.col("currency").isNotNull() & (F.col("currency") != "PEN"),
        "description_empty": F.col("description_empty"),
        "description_rescued": F.col("description_rescued"),
        "description_short": F.col("description_short"),
        "quotes_lost": F.col("quotes_lost"),
        "mojibake": F.col("mojibake"),
        "location_off": F.col("location_off"),
        "no_department": F.col("department").isNull(),
        "no_bidders": F.col("n_bidders").isNull(),
        "with_warnings": F.col("n_warnings") > 0,
        "in_analysis": F.col("in_analysis"),
    }
    counts = [F.count_if(c).alias(name) for name, c in flags.items()] + [F.count_if(F.col("version_kind") == k).alias(f"kind_{k}") for k in "ABCD"]
    rate = F.round(F.count_if(flags["amount_rescued"]) / F.greatest(F.lit(1), F.count_if(flags["amount_missing"])), 4)
    return valid.agg(F.count("*").alias("rows"), *counts, rate.alias("amount_rescue_rate"), F.round(F.avg(F.col("department").isNotNull().cast("int")), 4).alias("located_rate"))


def variant_counts(valid: DataFrame, columns: Sequence[str] = ("buyer_department", "buyer_region", "buyer_name_clean")) -> DataFrame:
    """How many keys of each column are written in more than one way."""
    parts = [spelling_variants(valid, c, accent_key(F.col(c))).agg(F.count("*").alias("variants")).select(F.lit(c).alias("column"), "variants") for c in columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def examples_per_class(df: DataFrame, kind: str, group: Sequence[str], groups: int = 3) -> DataFrame:
    """All rows of the first ``groups`` groups of each class, with their group's ``place``; classes that are null or empty have none.

    A task keeps the first groups of each class before they meet, and members
    come by a join with the few that are chosen: no class or group is gathered.
    """
    named = df.filter(F.col(kind) != "")
    order = W.partitionBy(kind).orderBy(*group)
    first = named.select(kind, *group).distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= groups)
    return same_keys(named, first, [kind, *group])


def text_pair(valid: DataFrame, before: str, after: str, mark: str = "¿", chars: int = 90) -> DataFrame:
    """One row (before, after): of the rows that ``quotes_lost`` marks, the one with the earliest ``mark``; none without such a row."""
    place = F.nullif(F.locate(mark, F.col(before)), F.lit(0))
    pair = F.struct(F.substring(before, 1, chars).alias("before"), F.substring(after, 1, chars).alias("after"))
    found = valid.filter(F.col("quotes_lost") & place.isNotNull()).agg(F.min_by(pair, F.struct(place, F.col("ocid"))).alias("pair"))
    return found.filter("pair IS NOT NULL").select("pair.*")


def news_located(news: DataFrame, valid: DataFrame) -> DataFrame:
    """API rows with the department that their buyer mostly has in the corpus."""
    return filled_by_mode_from(news, valid, "buyer_id", "department")


def filled_by_mode_from(df: DataFrame, known: DataFrame, by: str, value: str) -> DataFrame:
    from lodestar.operators.lookups import mode_of

    return df.join(mode_of(known, by, value, value), by, "left")
