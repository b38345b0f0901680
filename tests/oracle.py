"""Runs a query and its SQL on the same tables and compares all rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


def _plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_plain(row[i]) for i in order) for row in values)


def assert_same(query, sql, spark, sf_dir, c):
    got = query(spark, sf_dir)
    want = c.execute(sql)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
