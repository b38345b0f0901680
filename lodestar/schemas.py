"""Schemas (as DDL) of the tables that the sources read and the pipelines pass on; nothing is inferred."""

from __future__ import annotations

PARTY = "struct<id:string,roles:array<string>,additionalIdentifiers:array<struct<scheme:string,id:string>>,address:struct<department:string,region:string,locality:string>>"
_tender = (
    "struct<id:string,title:string,description:string,procurementMethodDetails:string,mainProcurementCategory:string,datePublished:string,"
    "value:struct<amount:double,currency:string,amount_PEN:double>,tenderPeriod:struct<startDate:string>,numberOfTenderers:int,"
    "tenderers:array<struct<id:string>>,items:array<struct<description:string,statusDetails:string,classification:struct<id:string>>>>"
)
_compiled = f"struct<ocid:string,date:string,dataSegmentation:struct<id:string>,buyer:struct<id:string,name:string>,parties:array<{PARTY}>,tender:{_tender},awards:array<struct<value:struct<amount:double>,suppliers:array<struct<id:string>>>>>"


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a flat schema."""
    return [tuple(part.split(" ", 1)) for part in ddl.split(", ")]


def names(ddl: str) -> list[str]:
    return [name for name, _ in fields(ddl)]


#: One nested source record.
RECORD = f"ocid string, releases array<struct<date:string>>, compiledRelease {_compiled}"
#: A package of records, as one JSON document.
PACKAGE = f"records array<struct<ocid:string,releases:array<struct<date:string>>,compiledRelease:{_compiled}>>"
#: One flat row per process.
PROCESS = (
    "ocid string, file_month string, segment string, compiled_at string, n_releases int, last_release_at string, tender_id string, title string, "
    "description string, method string, category string, amount double, currency string, amount_local double, published_at string, opened_at string, "
    "buyer_id string, buyer_name string, buyer_tax_id string, buyer_department string, buyer_region string, buyer_locality string, n_bidders int, "
    "n_bidders_listed int, n_items int, item_states string, item_descriptions string, item_classes string, n_awards int, awarded_amount double, n_suppliers int"
)
PAGE = "document string, page int, text string, chars int"
PARAGRAPH = "document string, page int, pos int, text string"
CHUNK = (
    "id string, text string, metadata struct<document:string,title:string,kind:string,version:string,version_date:string,page:int,amends:string,"
    "article:string,articles_inside:string,amended_by:string,amended_on:string,chars:int,hash:string>"
)
VERSION_NOTE = "document string, pos int, page int, action string, norm string, dated string, old_pages array<int>, label string, state string, old_text string, new_text string"
CALL_LOG = "called_at timestamp, model string, tokens_in long, tokens_cached long, tokens_out long, latency_s double, cost_usd double, band string, success boolean, error string, question string"
#: The API's monthly news rows.
NEWS = (
    "ocid string, published_at string, title string, description string, buyer_id string, buyer_name string, category string, method string, "
    "amount double, currency string, item_states string, n_bidders int, source_page int"
)
