from pyspark.sql import functions as F

from lodestar.functions import dates, text as tx
from lodestar.functions.geometry import geojson, simplified

import numpy as np


def one(spark, values, *columns):
    names = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], names).select(*columns).first()


def test_keys_and_repairs(spark):
    row = one(
        spark, {"a": ("string", "  Junín   ñandú "), "b": ("string", None), "c": ("string", "OBRA: ¿MEJORA¿ CUSCO"), "d": ("string", "¿Qué? Â si"), "e": ("string", "a\\nb  c")},
        tx.accent_key(F.col("a")), tx.accent_key(F.col("b")), tx.repaired(F.col("c")), tx.repaired(F.col("d")), tx.literal_newlines_out(F.col("e")), tx.accent_key_full(F.col("a")),
    )
    assert list(row) == ["JUNIN NANDU", "", 'OBRA: "MEJORA" CUSCO', "¿Qué? si", "a b c", "JUNIN NANDU"]


def test_keys_of_all_marks(spark):
    texts = ["e\u0301cole", "ŞIRNAK Ż ő Ǖ", "Άλφα Ёж", "ＡＢ\u3000c", "N\u0303andu\u0308", "straße ½ ﬁn", "ª º ø"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r) for r in df.select(tx.accent_key(F.col("t")), tx.accent_key_full(F.col("t"))).collect()]
    assert [a for a, _ in got][:5] == ["ECOLE", "SIRNAK Z O U", "ΑΛΦΑ ЕЖ", "AB C", "NANDU"]
    assert all(a == b for (a, b), t in zip(got, texts, strict=True) if t != texts[5])


def test_lines_and_ligatures(spark):
    text, n = tx.ligatures_joined(F.col("t"))
    row = one(spark, {"t": ("string", "Caliﬁ cación de ﬂujo, ofﬁ"), "l": ("array<string>", [" uno-", "dos ", "", " tres"])}, text, n, tx.joined_lines(F.col("l")))
    assert list(row) == ["Calificación de flujo, offi", 2, "uno-dos tres"]


def test_citations_ids_and_pages(spark):
    row = one(
        spark, {"t": ("string", "As [F2] and [F7] , see [F1].")},
        tx.citations_set(F.col("t"), F.array(F.lit("(a, p. 1)"), F.lit("(b, p. 2)"))), tx.numbers_cited(F.col("t")), tx.pages_of(F.lit("x:1,2;y:3;bad")),
    )
    assert row[0] == "As (b, p. 2) and, see (a, p. 1)."
    assert row[1] == [2, 7, 1]
    assert [tuple(p) for p in row[2]] == [("x", 1), ("x", 2), ("y", 3)]


def test_secrets_money_and_days(spark):
    row = one(
        spark, {"e": ("string", "bad key sk-abc*_12 " + "x" * 300), "m": ("double", 1234.5), "d": ("int", 20260131), "n": ("int", -1)},
        tx.mask_secrets(F.col("e")), tx.money(F.col("m"), F.col("m") > 0), tx.money(F.col("m"), F.col("m") < 0), tx.day(F.col("d")), tx.day(F.col("n")),
    )
    assert row[0].startswith("bad key sk-[hidden] xxx") and len(row[0]) == 200
    assert list(row)[1:] == ["S/ 1,234.50", "no published amount", "2026-01-31", "no date"]


def test_dates(spark):
    row = one(
        spark, {"a": ("string", "2026-01-01T03:00:00Z"), "b": ("string", "nonsense"), "c": ("string", "2026-13-01"), "t": ("timestamp_ntz", __import__("datetime").datetime(2026, 1, 1, 3, 0))},
        dates.day_number(dates.utc_timestamp(F.col("a"))), dates.utc_timestamp(F.col("b")), dates.is_iso_day(F.col("c")), dates.local_date(F.col("t")).cast("string"), dates.local_time(F.col("t")),
        dates.in_band(F.lit("23:59"), F.lit("08:30"), F.lit("24:00")), dates.in_band(F.lit("08:30"), F.lit("00:00"), F.lit("08:30")),
    )
    assert list(row) == [20260101, None, False, "2025-12-31", "22:00", True, False]


def test_simplification_keeps_corners_and_drops_islands(spark):
    line = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [0, 2], [0, 0]], dtype=float)
    assert simplified(line, 0.1).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    tiny = [[0.0, 0.0], [0.001, 0.0], [0.0, 0.001], [0.0, 0.0]]
    shapes = spark.createDataFrame([("A", [[line.tolist()], [tiny]])], "name string, polygons array<array<array<array<double>>>>")
    feature = geojson(shapes, "name", "polygons", 0.1, 3).first()["feature"]
    assert feature.count("[[[") == 1 and '"name":"A"' in feature
