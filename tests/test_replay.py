import random

import pytest
from pyspark.sql import functions as F

from lodestar.plans import evaluation as E, replay as R

FIELDS = ("department", "category", "amount_min")


def run(i, kind, top=0.9, gold=0.9, turned=False, empty=False, cited=(), invalid=(), wanted=None, found=None, error=None):
    return (i, kind, error, wanted or {}, found or {}, top, gold, turned, empty, list(cited), list(invalid), 0.001, 2)


def runs():
    """16 questions inside, one of an empty selection, eight outside; six of those are turned away."""
    out = [run(f"Q{k:02d}", "inside", 0.84 + k / 200, 0.85, cited=[f"p{k}", "p99", f"p{k}"] if k not in (3, 8) else ["p99"], wanted={"department": "CUSCO", "amount_min": "100"}, found={"department": "CUSCO", "amount_min": "100.5"}) for k in range(16)]
    out.append(run("S01", "empty", None, None, empty=True, wanted={"category": "Obras"}, found={"category": "Obras"}))
    out += [run(f"F{k:02d}", "outside", 0.795 + k / 100, 0.79 + k / 100, turned=k not in (2, 6), found={"department": "LIMA"} if k == 5 else None) for k in range(1, 9)]
    return out


@pytest.fixture(scope="module")
def saved(spark):
    return spark.createDataFrame(runs(), R.RUN)


@pytest.fixture(scope="module")
def relevant(spark):
    return spark.createDataFrame([(f"Q{k:02d}", f"p{k}") for k in range(16)] * 2, "id string, item string")


def test_figures_of_a_saved_run(spark, saved, relevant):
    assert R.summary(saved, relevant).first().asDict() == {
        "questions": 25, "cost_usd": 0.025, "calls": 50, "errors": 0, "empty": 1, "empty_right": 1, "outside_without_results": 0, "inside_without_results": 0,
        "answered_inside": 16, "with_invalid_ids": 0, "cite_relevant": 14,
    }
    assert R.field_results(saved, FIELDS, ["amount_min"]).first().asDict() == {"questions": 25, "right_department": 24, "right_category": 25, "right_amount_min": 25, "all_right": 24}
    hits = spark.createDataFrame([(f"Q{k:02d}", 1 + k % 4, f"p{k}") for k in range(15)] + [("Q15", 1, "other")], "id string, rank int, item string")
    assert R.found_within(saved, hits, relevant, (1, 3, 5)).first().asDict() == {"questions": 16, "recall_1": 0.25, "recall_3": 0.75, "recall_5": 0.938}


def test_options_and_states(saved):
    got = {r["threshold"]: r.asDict() for r in R.options(saved, (0.8, 0.83, 0.85)).collect()}
    assert got[0.83]["gate_right"] == 3 and got[0.8]["gate_right"] == 0 and got[0.85]["gate_wrong"] == 0
    assert [got[t]["final_right"] for t in (0.8, 0.83, 0.85)] == [6, 7, 7] and [got[t]["final_wrong"] for t in (0.8, 0.83, 0.85)] == [0, 0, 2]
    assert got[0.8]["let_through_ids"] == "F02 F06" and got[0.83]["let_through_ids"] == "F06" and got[0.85]["lost_ids"] == "Q00 Q01"
    assert got[0.8]["drafting_calls"] == 24 and got[0.83]["drafting_calls"] == 21
    states = {(r["id"], r["state"]) for r in R.states(saved, [0.83]).collect()}
    assert {("S01", "no results"), ("F01", "below threshold"), ("F06", "answered"), ("F08", "turned away"), ("Q00", "answered")} <= states and len(states) == 25


def test_errors_nulls_and_repeats(spark, relevant):
    rows = [run("Q00", "inside", error="timeout", cited=["p0"]), run("Q01", "inside", None, None, cited=["p1"]), run("Q01", "inside", None, None, cited=[]), (None,) * 13, run("F1", "outside", error="x", turned=True)]
    df = spark.createDataFrame(rows, R.RUN)
    got = R.summary(df, relevant).first()
    assert (got.questions, got.errors, got.cite_relevant) == (5, 2, 1)
    option = R.options(df, [0.5]).first()
    assert (option.final_right, option.final_wrong, option.let_through_ids, option.drafting_calls) == (0, 0, "F1", 2)
    assert R.citations(df.filter("false"), relevant).count() == 0 and R.summary(df.filter("false"), relevant).first().questions == 0


def test_saved_as_csv(spark, tmp_path):
    (tmp_path / "run.csv").write_text('n,tipo,err,want,got,sim,oro,abst,nada,ids,malos,usd,k\nQ1,inside,,"{""department"": ""LIMA"", ""amount_min"": 5}","{}",0.9,,0,0,a b,,0.01,2\nQ2,empty,boom,,,,,0,1,,x,0.02,1\n')
    names = dict(id="n", kind="tipo", error="err", wanted="want", found="got", top_score="sim", gold_score="oro", model_abstained="abst", no_results="nada", cited="ids", invalid="malos", cost_usd="usd", calls="k")
    a, b = R.read_runs(spark, str(tmp_path / "run.csv"), names).orderBy("id").collect()
    assert a.wanted == {"department": "LIMA", "amount_min": "5"} and a.found == {} and a.cited == ["a", "b"] and a.invalid == [] and a.error is None and a.gold_score is None
    assert b.error == "boom" and b.no_results and b.wanted == {} and b.invalid == ["x"] and b.calls == 1
    assert '"calls": 3' in R.as_json(R.summary(R.read_runs(spark, str(tmp_path / "run.csv"), names), spark.createDataFrame([], "id string, item string")).first())


def test_pages_cited(spark, saved):
    cited = spark.createDataFrame([("Q00", "ley", 3), ("Q00", "ley", 4), ("Q01", "ley", 9), ("F02", "ley", 1)], "id string, document string, page int")
    expected = E.expected_pages(spark.createDataFrame([("Q00", "ley:4"), ("Q01", "ley:8;otro:9")], "id string, expected_pages string")).withColumnRenamed("question", "id")
    assert R.pages_cited(saved.filter("id IN ('Q00', 'Q01', 'F02')"), cited, expected).first().asDict() == {"answered": 2, "cite_expected": 1}


def test_models_compared_with_auc(spark):
    hits = [(m, f"q{q}", r, r == (1 + q % 3 if m == "a" else 1 + q % 2), float(10 * q + 1), 0.5) for m in "ab" for q in range(12) for r in range(1, 4)]
    scores = [(m, f"q{q}", 0.9 - q / 100 - (0.05 if m == "b" else 0), q < 8) for m in "ab" for q in range(12)] + [("b", "x", 0.845, False)]
    df, sc = spark.createDataFrame(hits, "model string, question string, rank int, hit boolean, latency_ms double, cost double"), spark.createDataFrame(scores, "model string, question string, score double, inside boolean")
    got = {r["model"]: r for r in E.model_comparison(df, (1, 3), sc).collect()}
    assert (got["a"].auc, got["a"].outside_above, got["b"].outside_above) == (1.0, 0, 1) and got["b"].auc == round((8 * 4 + 7) / 40, 6) or got["b"].auc < 1
    import statistics

    assert got["a"].p90_ms == round(statistics.quantiles([10.0 * q + 1 for q in range(12)], n=10)[8], 2) and got["a"].recall_1 == round(4 / 12, 4) and got["a"].inside_least == pytest.approx(0.83)


def test_paired_differences(spark):
    r = random.Random(3)
    rows = [(m, f"q{q}", float(r.random() < p), None if m == "b" and q == 0 else r.random()) for q in range(80) for m, p in (("a", 0.4), ("b", 0.8), ("c", 0.4))]
    df = spark.createDataFrame(rows, "model string, question string, recall_1 double, rr double").repartition(5)
    one, again = ({(x["model"], x["measure"]): x.asDict() for x in E.paired_differences(d, "a", ["recall_1", "rr"], 400).collect()} for d in (df, df.repartition(2)))
    assert set(one) == {(m, k) for m in "bc" for k in ("recall_1", "rr")} and one[("b", "rr")]["questions"] == 79
    for key, row in one.items():
        assert row["low"] == pytest.approx(again[key]["low"]) and row["low"] <= row["difference"] <= row["high"]
    values = {(m, q): v for m, q, v, _ in rows}
    d = [values["b", f"q{q}"] - values["a", f"q{q}"] for q in range(80)]
    mean, sd = sum(d) / 80, (sum((x - sum(d) / 80) ** 2 for x in d) / 80) ** 0.5
    got = one[("b", "recall_1")]
    assert got["difference"] == pytest.approx(mean) and got["above"] > 0.99
    assert got["low"] == pytest.approx(mean - 1.96 * sd / 80**0.5, abs=0.05) and got["high"] == pytest.approx(mean + 1.96 * sd / 80**0.5, abs=0.05)
