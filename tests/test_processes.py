import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from lodestar.operators import filters, risk
from lodestar.plans import processes as P, reports
from lodestar.schemas import PROCESS, RECORD, names


def process(**given):
    base = dict.fromkeys(names(PROCESS))
    base |= {"file_month": "2026-01", "n_releases": 1, "compiled_at": "2026-01-10T00:00:00Z", "published_at": "2026-01-05T10:00:00Z", "currency": "PEN", "item_states": "", "item_descriptions": "", "n_awards": 0, "buyer_department": "LIMA", "buyer_id": "b", "method": "open"}
    return tuple((base | given)[n] for n in names(PROCESS))


@pytest.fixture(scope="module")
def rules(spark):
    pairs = lambda *rows: spark.createDataFrame(list(rows), "key string, department string")
    return P.Rules(pairs(("LIMA", "Lima"), ("CUSCO", "Cusco")), pairs(("NASCA", "Ica"), ("LIMA", "Lima")), pairs(("WANCHAQ", "Cusco")), {"Nazca": "Nasca"}, {"goods": "Bienes"}, ("DESIERTO",))


def valid(spark, rules, *rows):
    made = [process(**({"ocid": f"o{i}", "title": f"t{i}", "tender_id": f"x{i}", "description": "a plain description"} | r)) for i, r in enumerate(rows)]
    out = P.validated(spark.createDataFrame(made, PROCESS), rules)
    return {r.ocid: r for r in out.collect()}


def test_same_tender_keeps_the_newest(spark, rules):
    got = valid(spark, rules, {"tender_id": "s", "compiled_at": "2026-01-01"}, {"tender_id": "s", "compiled_at": "2026-01-02"}, {"tender_id": None}, {"tender_id": None})
    assert [got[f"o{i}"].in_analysis for i in range(4)] == [False, True, True, True]


def test_version_kinds(spark, rules):
    day = lambda n: f"2026-01-{n:02d}T10:00:00Z"
    got = valid(
        spark, rules,
        {"title": "A", "published_at": day(1), "item_states": "DESIERTO"}, {"title": "A", "published_at": day(3)},
        {"title": "B", "description": "first long text"}, {"title": "B", "description": "second long text"},
        {"title": "C", "compiled_at": "2026-01-11"}, {"title": "C", "compiled_at": "2026-01-12"},
        {"title": "D", "published_at": day(1)}, {"title": "D", "published_at": day(2)},
        {"title": "E", "buyer_id": None}, {"title": "E", "buyer_id": None},
    )
    assert [got[f"o{i}"].version_kind for i in range(10)] == ["A", "A", "B", "B", "C", "C", "D", "D", "", ""]
    assert [got[f"o{i}"].is_current for i in range(10)] == [False, True, True, True, False, True, False, True, True, True]
    # the same day and description twice: one is counted
    assert [got[f"o{i}"].in_analysis for i in (4, 5)] == [False, True]


def test_amounts(spark, rules):
    got = valid(
        spark, rules,
        {"amount": 0.0, "awarded_amount": 7.0}, {"amount": 0.0}, {"amount": 5.0, "amount_local": 0.0}, {"amount": 5.0, "currency": "USD", "amount_local": 20.0}, {"amount": 5.0, "currency": "USD", "amount_local": 0.0},
    )
    assert [(got[f"o{i}"].amount_local, got[f"o{i}"].amount_source, got[f"o{i}"].amount_valid) for i in range(5)] == [(7.0, "awarded", True), (0.0, "", False), (5.0, "called", True), (20.0, "called", True), (None, "", False)]


def test_descriptions_and_names(spark, rules):
    got = valid(spark, rules, {"description": " ", "item_descriptions": "from items"}, {"description": None}, {"description": "corta"}, {"description": "una\\ndos líneas ¿x¿ y más"}, {"buyer_name": " A  B "})
    assert [got[f"o{i}"].description_clean for i in range(4)] == ["from items", "", "corta", 'una dos líneas "x" y más']
    assert got["o1"].warnings[1] == "no description: not indexed" and got["o2"].description_short
    assert got["o4"].buyer_name_clean == "A B"


def test_location_cascade(spark, rules):
    far = {"buyer_department": None}
    got = valid(
        spark, rules,
        {"buyer_department": " Cúsco ", "buyer_id": "e"}, far | {"buyer_region": "NAZCA"}, far | {"buyer_locality": "Wanchaq", "buyer_id": "d"}, far | {"buyer_id": "e"}, far | {"buyer_id": "z"}, {"buyer_department": "Lima", "buyer_region": "Nasca"},
    )
    assert [(got[f"o{i}"].department, got[f"o{i}"].department_source) for i in range(6)] == [("Cusco", "declared"), ("Ica", "province"), ("Cusco", "district"), ("Cusco", "same entity"), (None, ""), ("Lima", "declared")]
    assert got["o5"].location_off and not got["o0"].location_off


def test_no_row_is_lost_and_the_report_counts(spark, rules):
    df = spark.createDataFrame([process(ocid="a", tender_id="1", title="x", amount=1.0), process(ocid="b", tender_id="1", title="y")], PROCESS)
    out = P.validated(df, rules)
    report = P.quality_report(out).first()
    assert (report["rows"], report.excluded_same_tender, report.in_analysis, report.amount_missing) == (2, 1, 1, 1)
    empty = P.quality_report(P.validated(df.filter("false"), rules)).first()
    assert empty["rows"] == 0


def test_flatten_null_safe(spark):
    def record(**compiled):
        parts = ("ocid", "date", "dataSegmentation", "buyer", "parties", "tender", "awards")
        return ("o", [{"date": "2026-01-01"}, {"date": "2026-02-01"}], tuple(compiled.get(p) for p in parts))

    party = lambda i, roles, department: (i, roles, [("X", "1"), ("PE-RUC", f"ruc{i}")], (department, None, None))
    rows = [record(buyer=("1", "N"), parties=[party("1", ["x"], "by id"), party("2", ["buyer"], "by role")], awards=[((5.0,), [("s",), ("t",)]), (None, [("s",)])]), record(buyer=("1", "N"), parties=[party("1", ["x"], "by id")]), record()]
    got = P.flattened(spark.createDataFrame(rows, RECORD), F.lit("2026-01")).collect()
    assert [r.buyer_department for r in got] == ["by role", "by id", None]
    assert [(r.n_suppliers, r.awarded_amount, r.n_awards, r.last_release_at) for r in got] == [(2, 5.0, 2, "2026-02-01"), (0, None, 0, "2026-02-01"), (0, None, 0, "2026-02-01")]


def test_latest_of_files(spark):
    a = spark.createDataFrame([process(ocid="a", compiled_at="2026-01-01"), process(ocid="b")], PROCESS)
    b = spark.createDataFrame([process(ocid="a", compiled_at="2026-02-01", file_month="2026-02", n_bidders=3)], PROCESS)
    got = {r.ocid: r for r in P.one_row_per_process([a, b]).collect()}
    assert (got["a"].n_bidders, got["a"].months, got["b"].months) == (3, "2026-01,2026-02", "2026-01")
    assert P.acquisition_report(a.union(b)).first().asDict() == {"rows": 3, "processes": 2, "repeated": 1, "changed": 1}


def test_wilson_and_report(spark):
    low, high = risk.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(1, 10), (0, 0), (10, 10)], "k int, n int").select(F.round(low, 4), F.round(high, 4)).collect()
    assert [tuple(r) for r in got] == [(0.0179, 0.4042), (0.0, 0.0), (0.7225, 1.0)]
    rows = [Row(ocid=str(i), in_analysis=True, n_awards=1, method="open" if i < 9 else "direct", n_bidders=1 if i < 2 else 3, department="d", buyer_id="b", buyer_name_clean="B") for i in range(10)]
    tables = reports.risk_report(spark.createDataFrame(rows), ["open"], least=1)
    assert tables["steps"].first().competitive == 9 and tables["by_buyer"].first().rate == 0.2222
    assert tables["ties"].first().asDict() == {"cut_rate": 0.2222, "in_all": 1, "inside": 1}


def test_filters():
    departments = {"LIMA": "Lima"}
    good, warned = filters.checked({"department": "lima", "category": "X", "amount_min": -1, "date_from": "2026-99-01", "date_to": "2026-01-31"}, departments, ["Bienes"], str.upper)
    assert good == {"department": "Lima", "date_to": "2026-01-31"} and len(warned) == 3
    both, against = filters.combined({"department": "Lima", "amount_min": 5.0}, {"departments": ["Cusco"], "amount_min": 9.0, "categories": ["Obras"]})
    assert against and both == {"department": "Lima", "amount_min": 9.0, "categories": ["Obras"]}


def test_empty_dashboard(spark):
    empty = spark.createDataFrame([], "amount double, valid boolean, area string, single boolean")
    assert reports.kpis(empty, "amount", "valid", "area", "single").first().asDict() == {"processes": 0, "amount": 0.0, "areas": 0, "single_rate": 0.0}


def test_news_located(spark):
    valid_rows = spark.createDataFrame([("b", "Lima"), ("b", "Lima"), ("b", "Cusco")], "buyer_id string, department string")
    news = spark.createDataFrame([("n", "b"), ("m", "c")], "ocid string, buyer_id string")
    assert {r.ocid: r.department for r in P.news_located(news, valid_rows).collect()} == {"n": "Lima", "m": None}


def test_calls(spark):
    calls = spark.createDataFrame([("m", True, 10, 1, "0.5", dt.datetime(2026, 1, 1), "q")], "model string, success boolean, tokens_in long, tokens_out long, cost_usd string, called_at timestamp, question string")
    assert reports.call_costs(calls).first().cost_usd == 0.5 and reports.last_calls(calls).count() == 1
