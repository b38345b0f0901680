import random

import pytest
from pyspark.sql import functions as F

from lodestar.plans import cube as C

SCHEMA = "month string, department string, category string, amount double, amount_valid boolean, single_bid boolean, buyer_id string, extra int"


def rows(n=3000, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        amount = r.choice([None, -5.0, 0.0, 10.0**4, round(10 ** r.uniform(2, 8), 2)])
        out.append((r.choice(["2026-01", "2026-02", "2026-03", None]), r.choice(["LIMA", "CUSCO", None]), r.choice(["Obras", "Bienes"]), amount, r.choice([True, True, False, None]), r.choice([True, False, None]), r.choice([None, f"b{r.randrange(200)}"]), i))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube"))
    processes = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    C.write_cube(processes, path)
    return processes, C.read_cube(spark, path), path


SELECTIONS = [
    C.Selection(),
    C.Selection(months=["2026-01", "2026-03"]),
    C.Selection(departments=["LIMA"], categories=["Obras"]),
    C.Selection(amount_from=1e4, amount_below=1e6),
    C.Selection(months=["2026-02"], amount_below=0.0),
    C.Selection(departments=["NOWHERE"]),
    C.Selection(months=[]),
]


def direct(selection):
    out = []
    for month, department, category, amount, valid, single, buyer, _ in rows():
        amount = amount if valid else None
        if selection.months is not None and month not in selection.months or selection.departments is not None and department not in selection.departments or selection.categories is not None and category not in selection.categories:
            continue
        if selection.amount_from is not None and (amount is None or amount < selection.amount_from) or selection.amount_below is not None and (amount is None or amount >= selection.amount_below):
            continue
        out.append((month, department, category, amount, bool(single), buyer or ""))
    return out


def measures(chosen):
    amounts = sorted(a for *_, a, _, _ in chosen if a is not None)
    return len(chosen), round(sum(amounts), 2), round(sum(x[4] for x in chosen) / len(chosen), 4) if chosen else 0.0, len({x[5] for x in chosen}), amounts


def agree(row, chosen):
    n, total, rate, buyers, amounts = measures(chosen)
    assert (row["processes"], row["single_rate"]) == (n, rate) and row["amount"] == pytest.approx(total, abs=0.01)
    assert abs(row["buyers"] - buyers) <= max(1, 0.03 * buyers)
    for q, name in ((0.5, "median_amount"), (0.9, "p90_amount")):
        if amounts:
            below = sum(a <= row[name] for a in amounts) / len(amounts)
            strictly = sum(a < row[name] for a in amounts) / len(amounts)
            assert strictly - 0.03 <= q <= below + 0.03
        else:
            assert row[name] is None


@pytest.mark.parametrize("selection", SELECTIONS)
def test_any_selection_equals_the_direct_tables(stored, selection):
    _, cube, _ = stored
    chosen = direct(selection)
    row = C.header(cube, selection).first()
    agree(row, chosen)
    assert row["departments"] == len({x[1] for x in chosen} - {None})
    got = {(r["dimension"], r["value"]): r for r in C.tables(cube, selection).collect()}
    for at, name in ((0, "month"), (1, "department"), (2, "category")):
        values = {x[at] for x in chosen}
        assert {v for d, v in got if d == name} == values
        for v in values:
            agree(got[name, v], [x for x in chosen if x[at] == v])


def test_limits_that_no_band_has_are_refused(stored):
    with pytest.raises(ValueError, match="no limit"):
        C.header(stored[1], C.Selection(amount_from=5.0))


def test_one_month_is_replaced_alone(spark, stored):
    processes, _, path = stored
    before = C.header(C.read_cube(spark, path), C.Selection(months=["2026-01"])).first()
    C.write_cube(processes.filter("month = '2026-02'").limit(7), path)
    cube = C.read_cube(spark, path)
    assert C.header(cube, C.Selection(months=["2026-02"])).first()["processes"] == 7
    assert C.header(cube, C.Selection(months=["2026-01"])).first() == before
    assert C.tables(cube).filter("dimension = 'band'").agg(F.sum("processes")).first()[0] == C.header(cube).first()["processes"]
