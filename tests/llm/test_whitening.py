import math
import random

import numpy as np
import pytest

from lodestar.llm import whitening as wh
from lodestar.llm.queries import QUERIES
from tests.llm.test_oracle import SF

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n int"


def exact(rows, components=8):
    """(vec_id -> list of (deviation, whitened up to sign)), explained; all sums in Python integers."""
    rows = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows]
    n, dim = len(rows), len(rows[0][1])
    sums = [sum(x[j] for _, x in rows) for j in range(dim)]
    cov = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in rows) / n**3 for b in range(dim)] for a in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    out = []
    for i, x in rows:
        z = [n * a - s for a, s in zip(x, sums, strict=True)]
        out.append((i, sum(a * a for a in z), [float(np.dot([a / n for a in z], v)) / math.sqrt(e) if e > 0 else None for v, e in zip(vectors, values, strict=True)]))
    return out, values / np.trace(cov)


def vectors(seed, n, dim, scale=0.2):
    r = random.Random(seed)
    spread = [scale * (1 + 3 * k) / dim for k in range(dim)]
    return [(i, [float(np.float32(r.gauss(0.1, s))) for s in spread]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def compare(got, want, explained):
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_row) == sorted(i for i, _, _ in want)
    signs = None
    for i, deviation, white in want:
        mine = [by_row[i][k + 1] for k in range(len(white))]
        assert {m["deviation_exact"] for m in mine} == {str(deviation)}
        assert {m["deviation"] for m in mine} == {deviation if deviation < 2**63 else None}
        if signs is None:
            signs = [math.copysign(1, m["whitened"] * w) for m, w in zip(mine, white, strict=True)]
        np.testing.assert_allclose([m["whitened"] * s for m, s in zip(mine, signs, strict=True)], white, rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose([m["explained"] for m in mine], explained, rtol=1e-9)
        assert all(m["identity_error"] < 1e-9 and m["n"] == len(want) for m in mine)


@pytest.mark.parametrize(("n", "dim", "scale"), [(70, 5, 0.2), (40, 12, 1e-2), (30, 3, 1e9), (25, 4, 1e15)])
def test_matches_exact_integers(spark, n, dim, scale):
    rows = vectors(n, n, dim, scale)
    compare(wh.whitening_table(frame(spark, rows)).collect(), *exact(rows))


def test_scatter_is_exact_beyond_doubles():
    y = np.array([[2**62, -(2**63)], [2**62 - 1, 12345], [-(2**61) - 7, 2**62 + 1]] * 400, dtype=np.int64)
    scatter = wh.Scatter(2)
    scatter.add(y)
    plain = y.astype(object)
    assert scatter.sums.tolist() == plain.sum(axis=0).tolist()
    assert scatter.cross.tolist() == (plain.T @ plain).tolist()
    for row in scatter.rows():
        i, j, *parts = row
        value = sum(p << wh.DIGIT_BITS * k for k, p in enumerate(parts))
        assert value == (scatter.n if (i, j) == (-1, -1) else scatter.sums[j] if i < 0 else scatter.cross[i, j])
        assert all(-(2**63) <= p < 2**63 for p in parts)


def test_bad_rows_go_and_repeats_stay(spark):
    good = vectors(9, 20, 3)
    bad = [(100, None), (101, [None, 0.1, 0.2]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("inf"), 0.0]), (104, []), (105, [0.1, 0.2])]
    rows = [*good, *bad]
    got = wh.whitening_table(frame(spark, rows)).collect()
    compare(got, *exact(good))
    twice = wh.whitening_table(frame(spark, [*rows, good[0], (None, [0.3, 0.1, 0.2])])).collect()
    assert len(twice) == 22 * 3 and {r["n"] for r in twice} == {22}
    assert sum(r["vec_id"] == good[0][0] for r in twice) == 6 and sum(r["vec_id"] is None for r in twice) == 3


def test_no_rows_and_no_variance(spark):
    assert wh.whitening_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whitening_table(frame(spark, [(1, None), (2, [])])).count() == 0
    same = wh.whitening_table(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = sorted(wh.whitening_table(frame(spark, [(1, [0.5, 0.25]), (2, [1.5, 0.25])])).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [round(abs(r["whitened"]), 9) if r["whitened"] is not None else None for r in line] == [1.0, None, 1.0, None]
    assert [r["explained"] for r in line] == [1.0, 0.0, 1.0, 0.0]


def test_entries_beyond_a_long_take_its_end():
    got = wh.shifted(np.array([[1e30, -1e30, 0.5, (2.0**63 - 2**11) / 1024]]))
    assert got.tolist() == [[2**63 - 1 - wh.OFFSET, -(2**63), 512, 2**63 - 1 - wh.OFFSET]]


def test_query_on_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, SF).collect(), *exact(rows))
