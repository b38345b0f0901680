"""Cases that a reviewer found: rows that the small tables do not have."""

import duckdb

from lodestar.plans import queries as engine
from tests.oracle import assert_same


def _tables(spark, tmp_path, **tables):
    """A folder with the tables (rows, schema) and a connection that sees them."""
    c = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), c


def test_laws_without_a_word(spark, tmp_path):
    texts = ["", "12 34", "  \n", "uno dos", "7 " * 30 + "late", "—"]
    rows = [(i, texts[i % len(texts)]) for i in range(40)]
    where, c = _tables(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    for name in ("version_texts_in_force", "version_register"):
        assert_same(engine.QUERIES[name], engine.ORACLE[name], spark, where, c)


def test_all_questions_turned_away_are_listed(spark):
    from lodestar.operators.metrics import threshold_options

    ids = [*range(0, 12000, 7), 100000, 100001, 10000]
    runs = spark.createDataFrame([(i, -0.5, i % 5 == 0, False) for i in ids], "id long, score double, outside boolean, verdict boolean")
    got = {r.threshold: r.wrongly_gated for r in threshold_options(runs, (-1.0, 0.0), 0.1).collect()}
    assert got == {-1.0: "", 0.0: ",".join(sorted(str(i) for i in ids if i % 5))}


def test_chunks_leave_a_task_before_its_batch_ends():
    import pyarrow as pa

    from lodestar.operators.chunks import RUN, chunk_rows, packed

    texts = [None, "", *("palabra " * (i % 90) + "\n\n" + "x" * i for i in range(400))]
    batch = pa.record_batch({"document": [str(i) for i in range(len(texts))], "page": pa.array([1] * len(texts), pa.int32()), "text": texts})
    got = list(chunk_rows(iter([batch]), 60, 10))
    assert len(got) == -(-len(texts) // RUN) and all(len(set(x.column("document").to_pylist())) <= RUN for x in got)
    rows = [(r["document"], r["n"], r["text"]) for x in got for r in x.to_pylist()]
    assert rows == [(str(i), n, c) for i, t in enumerate(texts) for n, c in enumerate(packed(t or "", 60, 10))]


def test_validation_computes_its_rows_once(spark):
    from pyspark.sql import functions as F

    from lodestar.plans import processes as P
    from lodestar.schemas import PROCESS, names

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    some = {"buyer_id": "b1", "title": "t", "published_at": "2026-01-02T00:00:00Z", "item_states": "", "item_descriptions": "", "buyer_department": "LIMA"}
    # one id twice: every row stays, and no row comes twice
    rows = [{**some, "ocid": o, "tender_id": o, "compiled_at": c} for o, c in (("a", "2026-01-01"), ("a", "2026-01-02"), ("b", "2026-01-01"))] + [{**some, "ocid": "c", "title": None}, {**some, "ocid": "d", "title": None}]
    df = spark.createDataFrame([tuple(r.get(n) for n in names(PROCESS)) for r in rows], PROCESS)
    df = df.withColumn("buyer_id", F.udf(counted, "string")("buyer_id"))
    pairs = spark.createDataFrame([("LIMA", "LIMA")], "key string, department string")
    valid = P.validated(df, P.Rules(pairs, pairs, pairs, {}, {"x": "y"}, ("CANCELLED",))).collect()
    assert sorted(r.ocid for r in valid) == ["a", "a", "b", "c", "d"] and seen.value == len(rows)
    assert {r.ocid: r.version_kind for r in valid} == {"a": "C", "b": "C", "c": "", "d": ""} and "_apart" not in valid[0].asDict()


def test_archives_of_one_task_are_bounded():
    import hashlib
    import json
    import zipfile
    from io import BytesIO

    import pyarrow as pa

    from lodestar.plans.process_queries import packages

    texts = [json.dumps({"ocid": f"o{i}", "x": hashlib.sha256(str(i).encode()).hexdigest()}) for i in range(3000)]
    got = [x for p in packages(iter([pa.record_batch({"json": texts[:1500]}), pa.record_batch({"json": texts[1500:]})]), "part-0", 16384) for x in p.to_pylist()]
    assert len(got) > 2 and len({x["path"] for x in got}) == len(got)
    records = [r for x in got for r in json.loads(zipfile.ZipFile(BytesIO(x["content"])).read("package.json"))["records"]]
    assert records == list(map(json.loads, texts)) and not list(packages(iter([]), "part-1"))


def test_a_build_deals_texts_once(spark, tmp_path):
    from lodestar.operators import index
    from tests.test_sources import Toy

    def rows(*pairs):
        return index.to_index(spark.createDataFrame(list(pairs), "id string, text string"), "id", "text", {})

    path = str(tmp_path / "index")
    index.build(rows(*((f"i{k}", f"t{k}") for k in range(40))), path, Toy, steps=2, buckets=4)
    first = index.committed(spark, path)["folders"]
    # every step's rows stay where they were written, and later builds keep them beside their own
    assert len({f.split("/")[1] for fs in first.values() for f in fs}) == 2
    now = [(f"i{k}", f"t{k}" if k % 3 else "new") for k in range(1, 45)]
    got = {r.id: (r.text, r.embedding[0]) for r in index.build(rows(*now), path, Toy, steps=2).collect()}
    assert got == {i: (t, float(len(t))) for i, t in now}
    changed = index._changes(rows(*now), index.open_index(spark, path), 4)
    assert changed.count() == 0 and "Join" not in changed._jdf.queryExecution().executedPlan().toString()
    # a commit of before names one folder a bucket
    assert index._folders({"folders": {"1": "data/x/bucket=1"}}, "1") == ["data/x/bucket=1"]
