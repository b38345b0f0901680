import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import nearest as N
from lodestar.operators.search import top_k

CORPUS = "id long, embedding array<float>, rank int, cell string"
ASKED = "query_id string, vector array<double>"


def unit(r, dim):
    v = [r.gauss(0, 1) for _ in range(dim)]
    size = sum(x * x for x in v) ** 0.5
    return [float(np.float32(x / size)) for x in v]


def vectors(seed, n, dim=8, copies=0):
    r = random.Random(seed)
    out = [(i, unit(r, dim)) for i in range(n)]
    return out + [(n + i, out[3][1]) for i in range(copies)]


def brute(rows, asked, k):
    out = set()
    for q, vector in asked:
        scores = [(-float(np.einsum("n,n->", np.array(v), np.array(vector))), i) for i, v in rows if v is not None and len(v) == len(vector) and None not in v]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def frames(spark, rows, asked):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], CORPUS).repartition(4), spark.createDataFrame(asked, ASKED)


def got(df):
    return {(r["query_id"], r["id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("n", "k", "copies"), [(300, 7, 0), (5, 9, 0), (200, 5, 150), (1, 1, 0)])
def test_exact_search_equals_brute_force(spark, monkeypatch, n, k, copies):
    monkeypatch.setattr(N, "ROWS", 32)
    monkeypatch.setattr(N, "QUERIES", 3)
    rows = vectors(n, n, copies=copies)
    asked = [(f"q{i}", v) for i, v in rows[:10]] + [("far", [-x for x in rows[0][1]])]
    corpus, queries = frames(spark, rows, asked)
    assert got(N.nearest_per_query(corpus, queries, k)) == brute(rows, asked, k)


def test_queries_in_turns(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_BROADCAST", 4)
    rows = vectors(1, 60)
    asked = [(f"q{i}", v) for i, v in rows[:11]]
    corpus, queries = frames(spark, rows, asked)
    assert got(N.nearest_per_query(corpus, queries, 3)) == brute(rows, asked, 3)


def test_rows_and_queries_that_cannot_be_compared(spark):
    rows = [*vectors(2, 20), (90, None), (91, [0.5]), (92, [None] * 8)]
    asked = [("a", rows[0][1]), ("b", rows[1][1]), ("null", None), ("short", [1.0])]
    corpus, queries = frames(spark, rows, asked)
    assert got(N.nearest_per_query(corpus, queries, 30)) == brute(rows, asked[:2], 30)
    assert N.nearest_per_query(corpus, queries.filter("query_id = 'null'"), 3).count() == 0
    assert N.nearest_per_query(corpus, queries.filter("false"), 3).count() == 0
    assert N.nearest_per_query(corpus.filter("false"), queries, 3).count() == 0
    assert top_k(corpus, asked[0][1], 2).columns == ["id", "embedding", "rank", "cell", "similarity"]


def test_all_cells_are_the_exact_search_and_few_are_pruned(spark, tmp_path, capsys):
    rows = [*vectors(3, 600, dim=6, copies=200), (9000, None), (9001, [1.0])]
    asked = [(f"q{i}", v) for i, v in rows[:25]]
    corpus, queries = frames(spark, rows, asked)
    layout = N.lay_out(corpus.drop("cell"), str(tmp_path / "cells"), cells=16)
    assert layout.table(spark).count() == len(rows)
    truth = brute(rows, asked, 5)
    assert got(N.nearest_in_cells(layout, queries, 5, 16)) == truth
    probes = N.probes_for(layout, spark, 5)
    assert 1 <= probes < 16
    some = N.nearest_in_cells(N.open_cells(spark, layout.path), queries, 5, probes)
    assert len({(q, i) for q, i, _ in got(some)} & {(q, i) for q, i, _ in truth}) >= 0.9 * len(truth)
    capsys.readouterr()
    N.nearest_in_cells(layout, queries.limit(1), 5, 1).explain("formatted")
    assert re.search(r"PartitionFilters: \[.*\(?cell", capsys.readouterr().out)
    per = N.recall(some, N.nearest_per_query(corpus, queries, 5)).agg(F.sum("wanted"), F.avg("recall")).first()
    assert per[0] == len(truth) and per[1] >= 0.9


def test_cells_of_small_and_empty_tables(spark, tmp_path):
    corpus, queries = frames(spark, vectors(4, 3), [("a", vectors(4, 3)[0][1])])
    layout = N.lay_out(corpus.drop("cell"), str(tmp_path / "few"))
    assert got(N.nearest_in_cells(layout, queries, 2, 50)) == brute(vectors(4, 3), [("a", vectors(4, 3)[0][1])], 2)
    nothing = N.lay_out(corpus.drop("cell").filter("false"), str(tmp_path / "none"))
    assert len(nothing.centroids) == 0


def test_recall_of_the_registered_search(spark):
    from lodestar.plans.queries import QUERIES

    found = QUERIES["vector_cell_recall"](spark, "/root/testdata/sf0.01").agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert found >= 0.9
