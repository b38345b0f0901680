import statistics

import pytest
from pyspark.sql import functions as F

from lodestar.plans import processes as P, reports
from lodestar.schemas import NEWS, PROCESS, names
from lodestar.sources import files as files_module, sinks
from tests.test_processes import process, rules  # noqa: F401


def frame(spark, *rows):
    return spark.createDataFrame([process(**r) for r in rows], PROCESS)


def files(path):
    return {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_rerun_of_one_month_touches_that_month_alone(spark, tmp_path):
    path = tmp_path / "processes"
    sinks.write_processes(frame(spark, {"ocid": "a"}, {"ocid": "b", "file_month": "2026-02"}, {"ocid": "c", "file_month": None}), str(path))
    before = files(path)
    sinks.write_processes(frame(spark, {"ocid": "b2", "file_month": "2026-02"}, {"ocid": "b3", "file_month": "2026-02"}), str(path))
    after = files(path)
    assert {k: v for k, v in before.items() if "2026-02" not in k} == {k: v for k, v in after.items() if "2026-02" not in k}
    assert sorted(r.ocid for r in sinks.read_months(spark, str(path)).collect()) == ["a", "b2", "b3", "c"]
    assert [r.ocid for r in sinks.read_months(spark, str(path), ["2026-01"]).collect()] == ["a"]
    assert sinks.read_months(spark, str(path)).columns == names(PROCESS)


def test_rows_that_do_not_fit_are_refused(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = frame(spark, {"ocid": "a"})
    with pytest.raises(sinks.WrongSchema, match="amount is string, not double"):
        sinks.write_processes(rows.withColumn("amount", F.lit("x")), path)
    with pytest.raises(sinks.WrongSchema, match="ocid is missing"):
        sinks.write_processes(rows.drop("ocid"), path)
    with pytest.raises(sinks.WrongSchema, match="more is not in the table"):
        sinks.write_processes(rows.withColumn("more", F.lit(1)), path)
    sinks.write_processes(rows.select(*reversed(rows.columns)), path)
    assert sinks.read_months(spark, path).columns == names(PROCESS)


def test_validated_rows_and_news_round_trip(spark, rules, tmp_path):  # noqa: F811
    valid = P.validated(frame(spark, {"ocid": "a", "description": "una obra ¿A¿", "title": "t"}, {"ocid": "b", "description": "x ¿B¿ larga", "title": "u", "file_month": "2026-02"}), rules)
    sinks.write_validated(valid, str(tmp_path / "v"))
    back = sinks.read_months(spark, str(tmp_path / "v"))
    assert back.columns == valid.columns and sorted(map(str, back.collect())) == sorted(map(str, valid.collect()))
    with pytest.raises(sinks.WrongSchema):
        sinks.write_validated(valid.withColumn("later", F.lit(1)), str(tmp_path / "v"))
    news = spark.createDataFrame([tuple({"ocid": o, "published_at": d}.get(n) for n in names(NEWS)) for o, d in (("n1", "2026-03-05T10:00:00Z"), ("n2", None))], NEWS)
    sinks.write_news(news, str(tmp_path / "n"))
    assert [r.ocid for r in sinks.read_months(spark, str(tmp_path / "n"), ["2026-03"]).collect()] == ["n1"] and sinks.read_months(spark, str(tmp_path / "n")).count() == 2


def test_before_and_after_of_the_quotes(spark, rules):  # noqa: F811
    valid = P.validated(frame(spark, {"ocid": "a", "description": "una obra ¿A¿ nueva", "title": "t"}, {"ocid": "b", "description": "x ¿B¿ larga de verdad", "title": "u"}, {"ocid": "c", "description": "¿de verdad? no", "title": "v"}), rules)
    assert P.text_pair(valid, "description", "description_clean").first().asDict() == {"before": "x ¿B¿ larga de verdad", "after": 'x "B" larga de verdad'}
    assert P.text_pair(valid.filter("ocid = 'c'"), "description", "description_clean").count() == 0


def test_examples_are_whole_groups_of_the_first_three(spark):
    rows = [(k, g, i) for k in ("A", "B", "", None) for g in "edcba" for i in range(3)]
    df = spark.createDataFrame(rows, "kind string, g string, i int")
    got = {tuple(r) for r in P.examples_per_class(df, "kind", ["g"]).select("kind", "g", "i", "place").collect()}
    assert got == {(k, g, i, place) for k in "AB" for place, g in enumerate("abc", 1) for i in range(3)}


def test_chunk_sizes_of_each_configuration(spark):
    texts = {"c500": ["a b " * n for n in range(1, 40)], "c1000": ["word " * n for n in range(1, 30)], "one": ["single"]}
    rows = [(c, f"d{i % 3}", t) for c, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "configuration string, document string, text string")
    got = {r["configuration"]: r for r in reports.chunk_sizes(df, ["configuration"], F.size(F.split(F.trim("text"), " ")), 60).collect()}
    for c, ts in texts.items():
        for name, values in (("chars", [len(t) for t in ts]), ("tokens", [len(t.split()) for t in ts])):
            p90 = int(statistics.quantiles(values, n=10)[-1]) if len(values) > 1 else values[0]
            assert [got[c][f"{name}_{k}"] for k in ("least", "median", "p90", "most")] == [min(values), int(statistics.median(values)), p90, max(values)]
        assert got[c].chunks == len(ts) and got[c].over_limit == sum(len(t.split()) > 60 for t in ts)
    assert reports.chunks_per_document(df, ["configuration"]).count() == 7
    hits = spark.createDataFrame([(c, q, r, r == 2) for c in texts for q in "xy" for r in (1, 2)], "configuration string, question string, rank int, hit boolean")
    scores = spark.createDataFrame([(c, q, s, q != "z") for c in texts for q, s in (("x", 0.9), ("y", 0.7), ("z", 0.8))], "configuration string, question string, score double, inside boolean")
    report = reports.configuration_report(df, hits, scores, "configuration", (1, 3), F.length("text"), 60).collect()
    assert len(report) == 3 and all((r.recall_1, r.recall_3, r.mrr, r.auc) == (0.0, 1.0, 0.5, 0.5) for r in report)


def test_lines_of_a_text_log(spark, tmp_path):
    path = str(tmp_path / "log")
    files_module.append_lines(spark, path, ["first  line", "second\nhalf"])
    files_module.append_lines(spark, path, [])
    files_module.append_lines(spark, path, ["third"])
    assert [r.line for r in files_module.read_lines(spark, path).orderBy("at").collect()] == ["first  line", "second half", "third"]
