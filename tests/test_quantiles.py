import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestar.operators import quantiles as Q


def frame(spark, groups):
    return spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(3)


def groups():
    r = random.Random(5)
    return {
        "even": [float(x) for x in range(1, 400)],
        "skewed": [r.paretovariate(0.7) for _ in range(500)],
        "copies": [3.0] * 400 + [1.0, 9.0],
        "two": [2.0, 7.0],
        "one": [4.0],
        None: [-1.0, 5.5, 5.5, 1e9, -1e9],
        "bad": [None, float("nan"), 2.0, 1.0],
    }


def test_exclusive_deciles_equal_the_list_form(spark):
    data = groups()
    got = {r["g"]: r["d"] for r in Q.exclusive(frame(spark, data), ["g"], "v", 0.9, "d").collect()}
    for g, values in data.items():
        values = [v for v in values if v is not None and not math.isnan(v)]
        want = statistics.quantiles(values, n=10)[8] if len(values) > 1 else values[0]
        assert got[g] == pytest.approx(want, rel=1e-12), g
    assert set(got) == set(data)


def test_places_of_a_whole_table(spark):
    values = sorted(random.Random(1).choices(range(-50, 5000), k=3000))
    df = frame(spark, {"x": map(float, values)})
    places = {"first": F.lit(-3), "third": F.lit(3), "middle": F.ceil(F.col("size") / 2), "last": F.col("size") + 5}
    got = {r["name"]: r["value"] for r in Q.at_places(df, [], "v", places).collect()}
    assert got == {"first": values[0], "third": values[2], "middle": values[1499], "last": values[-1]}
    assert Q.at_places(df.filter("false"), ["g"], "v", places).count() == 0


def test_no_rows_stand_in_a_window(spark):
    df = frame(spark, {"x": [1.0] * 50_000, "y": [2.0]})
    assert Q.value_counts(df, ["g"], "v").count() == 2
    assert {(r["g"], r["d"]) for r in Q.exclusive(df, ["g"], "v", 0.9, "d").collect()} == {("x", 1.0), ("y", 2.0)}
