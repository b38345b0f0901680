import io
import json
import struct
import zipfile

import pytest

from lodestar.operators import index
from lodestar.plans import evaluation as E
from lodestar.sources import archives, downloads, files, paged_api
from lodestar.streaming import jobs


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in members.items():
            archive.writestr(name.replace("__", "."), content)
    return out.getvalue()


def test_records_inside_zips(spark, tmp_path):
    package = {"records": [{"ocid": f"o{i}", "releases": [{"date": "d"}], "compiledRelease": {"tender": {"title": "t"}}} for i in range(3)]}
    (tmp_path / "2026-01.zip").write_bytes(zipped(a__json=json.dumps(package)))
    found = archives.read_binary(spark, str(tmp_path), "*.zip")
    rows = archives.zipped_records(found).collect()
    assert sorted(r.ocid for r in rows) == ["o0", "o1", "o2"] and rows[0].compiledRelease.tender.title == "t"
    assert archives.inner_digest(found).first().sha256 == downloads.inner_sha256((tmp_path / "2026-01.zip").read_bytes())


AWKWARD = [
    {"records": [{"a": 'quote " and \\ and \\" } ]', "b": [{"c": "{"}, []]}, {"é": "漢字 \\\\"}, {}], "more": [{"records": [1]}]},
    {"name": "records", "other": [{"records": [{"x": 1}]}], "deep": {"records": [{"y": 2}]}, "records": [{"z": [[[{}]]]}, 5, "text", None, [{"not": "one"}], {"last": {"records": [{}]}}]},
    {"records": []},
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("package", AWKWARD)
@pytest.mark.parametrize("indent", [None, 2])
def test_records_are_cut_wherever_chunks_end(package, size, indent):
    text = json.dumps(package, indent=indent, ensure_ascii=False).encode()
    cutter, out = archives.RecordCutter(), []
    for at in range(0, len(text), size):
        out += cutter.cut(text[at : at + size])
    cutter.finish("x")
    assert [json.loads(r) for r in out] == [r for r in package["records"] if isinstance(r, dict)]


@pytest.mark.parametrize(("text", "said"), [(b'{"other": []}', "no array"), (b'{"records": [{"a": 1}', "ends inside"), (b"", "no array"), (b"[1, 2]", "no array")])
def test_texts_without_whole_records_are_errors(text, said):
    with pytest.raises(ValueError, match=said):
        list(archives.cut_records(io.BytesIO(text), "x"))


def test_members_are_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 1000)
    package = lambda a, n: json.dumps({"records": [{"ocid": f"{a}{i}", "compiledRelease": {"tender": {"title": "x" * 300}}} for i in range(n)]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.zip").write_bytes(zipped(a__json=package("a", 50), b__json=package("b", 7), readme__txt="no"))
    (tmp_path / "n.zip").write_bytes(zipped(c__json=package("c", 3)))
    got = archives.member_records(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.member, r.ocid) for r in got.collect()) == sorted([("a.json", f"a{i}") for i in range(50)] + [("b.json", f"b{i}") for i in range(7)] + [("c.json", f"c{i}") for i in range(3)])
    assert archives.member_records(spark, f"file://{tmp_path}", members="c*").count() == 3
    with pytest.raises(Exception, match="nothing"):
        archives.member_records(spark, str(tmp_path / "nothing")).count()


def test_pages_keep_their_numbers(spark, tmp_path):
    (tmp_path / "ley.pdf").write_bytes(b"uno\fdos")
    got = archives.document_pages(archives.read_binary(spark, str(tmp_path), "*.pdf"), lambda content: content.decode().split("\f")).orderBy("page").collect()
    assert [tuple(r) for r in got] == [("ley", 1, "uno", 3), ("ley", 2, "dos", 3)]


def shapes():
    fields = [("DEP", 6), ("PROV", 6), ("DIST", 6)]
    head = struct.pack("<4xIHH", 2, 32 + 32 * len(fields) + 1, 1 + 18) + b"\0" * 20
    columns = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width]) + b"\0" * 15 for name, width in fields)
    rows = b" " + b"Lima  Lima  Ate   " + b" " + b"Cusco Anta  Anta  "
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]

    def shape(*rings):
        points = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        body = struct.pack("<I4dII", 5, 0, 0, 2, 2, len(rings), len(points)) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">II", 1, len(body) // 2) + body

    return zipped(D__dbf=head + columns + b"\r" + rows, D__shp=b"\0" * 100 + shape(ring, hole) + shape(ring))


def test_shape_archives(spark, tmp_path):
    (tmp_path / "d.zip").write_bytes(shapes())
    found = archives.read_binary(spark, str(tmp_path))
    rows = archives.shape_archive(found, "D", ["DEP", "PROV", "DIST"], outlines=True).collect()
    assert [r.DIST for r in rows] == ["Ate", "Anta"] and [len(r.polygons[0]) for r in rows] == [2, 1]
    named = archives.shape_archive(found, "D", ["DEP", "PROV", "DIST"]).toDF("department", "province", "district")
    departments, provinces, districts = archives.territory(named)
    assert {r.key: r.department for r in provinces.collect()} == {"LIMA": "Lima", "ANTA": "Cusco"}
    assert departments.count() == 2 and districts.count() == 2


class Server:
    """Three pages; fails with a status after ``good`` calls."""

    def __init__(self, good=99, status=503):
        self.good, self.status, self.calls = good, status, 0

    def __call__(self, url):
        self.calls += 1
        if self.calls > self.good:
            raise paged_api.HttpStatus(self.status)
        page = int(url.rsplit("=", 1)[1])
        return {"results": [{"ocid": f"o{page}"}, {"ocid": "shared"}], "has_next": page < 3}


def client(tmp_path, server):
    waits = []
    made = paged_api.PagedClient("http://x/?page={page}", tmp_path, server, sleep=waits.append)
    return made, waits


def test_ingestion_survives_a_broken_network(tmp_path):
    broken, waits = client(tmp_path, Server(good=2))
    rows, how = paged_api.ingested(broken, 10)
    assert len(rows) == 4 and how.startswith("partial") and waits[-3:] == [2, 4, 8]
    whole, _ = client(tmp_path, server := Server())
    rows, how = paged_api.ingested(whole, 10)
    assert how == "complete" and len(rows) == 6 and server.calls == 1
    assert paged_api.ingested(whole, 2)[1] == "page cap"
    other, _ = client(tmp_path / "x", Server(good=0, status=404))
    with pytest.raises(paged_api.HttpStatus):
        other.page(1)


def test_a_torn_page_is_fetched_again(tmp_path):
    made, _ = client(tmp_path, server := Server())
    (tmp_path / "page_00002.json").write_text('{"results": [{"oc')
    (tmp_path / "page_00003.json.part").write_text("left behind")
    rows, how = paged_api.ingested(made, 10)
    assert how == "complete" and len(rows) == 6 and server.calls == 3
    assert json.loads((tmp_path / "page_00002.json").read_text())["results"][0] == {"ocid": "o2"}


def test_lanes_read_every_page_once(tmp_path):
    for page in range(1, 8):
        (tmp_path / f"page_{page:05d}.json").write_text(json.dumps({"results": [{"n": page}], "has_next": page < 7}))
    for options in ({"last": "7", "lanes": "3"}, {"last": "7"}, {}):
        reader = paged_api.PagedReader({"url": "http://127.0.0.1:1/{page}", "cache": str(tmp_path)} | options)
        assert sorted(n for lane in reader.partitions() for n, _ in reader.read(lane)) == list(range(1, 8))


def test_api_as_a_data_source(spark, tmp_path):
    for page in (1, 2):
        (tmp_path / f"page_{page:05d}.json").write_text(json.dumps({"results": [{"ocid": "a", "buyer": {"id": "b"}}, {"ocid": f"o{page}"}]}))
    paged_api.registered(spark)
    pages = spark.read.format("paged_api").option("url", "http://127.0.0.1:1/{page}").option("last", "2").option("cache", str(tmp_path)).load()
    assert pages.count() == 4
    rows = {r.ocid: r for r in paged_api.news_rows(pages).collect()}
    assert set(rows) == {"a", "o1", "o2"} and rows["a"].source_page == 1 and rows["a"].buyer_id == "b"


def test_downloads(tmp_path):
    content = zipped(a__json="{}")
    calls = []
    fetch = lambda url: calls.append(url) or content
    digest = downloads.inner_sha256(content)
    assert downloads.download("u", tmp_path / "f.zip", digest, fetch) == "downloaded"
    assert downloads.download("u", tmp_path / "f.zip", digest, fetch) == "present" and len(calls) == 1
    with pytest.raises(ValueError, match="digest"):
        downloads.download("u", tmp_path / "g.zip", "0", fetch)
    assert not (tmp_path / "g.zip").exists()
    catalogue = [{"id": "b", "url": "ub"}, {"id": "a", "url": "ua"}]
    downloads.sync_documents(catalogue, tmp_path / "docs", fetch)
    assert [r["id"] for r in downloads.sync_documents(catalogue[1:], tmp_path / "docs", fetch)] == ["a"]
    assert [r["id"] for r in json.loads((tmp_path / "docs/manifest.json").read_text())] == ["a"]


def test_file_formats(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"documento":"x","document":"d","page":1,"text":"t","chars":1}\n')
    assert files.read_pages(spark, str(tmp_path / "p.jsonl")).first().document == "d"
    df = spark.createDataFrame([(1, 'a "q", b\nnext')], "id int, text string")
    files.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert files.read_csv(spark, str(tmp_path / "c"), "id int, text string").first().text == 'a "q", b\nnext'
    (tmp_path / "r.json").write_text('{"Q1": ["a", "b"], "Q2": []}')
    assert {tuple(r) for r in files.relevance(spark, str(tmp_path / "r.json")).collect()} == {("Q1", "a"), ("Q1", "b")}
    for model in "xy":
        files.append_calls(spark, str(tmp_path / "log"), [{"model": model, "success": True}])
    assert files.read_calls(spark, str(tmp_path / "log")).count() == 2
    assert json.loads(files.as_documents(df, "id").first().json)["id"] == 1
    assert files.markdown_table(df.collect()).count("\n") == 2
    assert json.loads(files.feature_collection(['{"type":"Feature"}']))["features"] == [{"type": "Feature"}]
    (tmp_path / "s.json").write_text('{"id": "Q", "question": "?", "filters": {"department": "Lima"}}')
    definition = files.load_settings(files.Definition, tmp_path / "s.json")
    assert files.definitions_table(spark, [definition]).first().filters == '{"department": "Lima"}'
    with pytest.raises(KeyError, match="unknown"):
        files.settings(files.Definition, {"nope": 1})


class Toy:
    name = "toy"

    def passages(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def query(self, text):
        return self.passages([text])[0]

    def tokens(self, text):
        return len(text)


def indexable(spark, *pairs):
    return index.to_index(spark.createDataFrame(list(pairs), "id string, text string"), "id", "text", {})


def test_index_is_idempotent_and_incremental(spark, tmp_path):
    rows = lambda *pairs: indexable(spark, *pairs)
    path = index.index_path(str(tmp_path), "toy", "c500")
    with pytest.raises(FileNotFoundError, match="no index"):
        index.open_index(spark, path)
    index.build(rows(("a", "x"), ("b", "yy"), ("c", " ")), path, Toy)
    old = index.open_index(spark, path)
    assert old.count() == 2 and index.pending(rows(("a", "x"), ("b", "yy")), old).count() == 0
    now = rows(("a", "x"), ("b", "changed"), ("d", "new"))
    assert index.upsert_counts(now, old).first().asDict() == {"to_index": 3, "already_there": 1, "upserted": 2, "deleted": 0, "total": 3}
    fresh = {r.id: r.embedding[0] for r in index.refreshed(now, old, Toy).collect()}
    assert fresh == {"a": 1.0, "b": 7.0, "d": 3.0} == {r.id: r.embedding[0] for r in index.build(now, path, Toy).collect()}


def test_embedders():
    seen = []
    marked = index.prefixed(lambda texts: seen.extend(texts) or [[1.0]] * len(texts), "m", batch=2)
    assert len(marked.passages(["a", "b", "c"])) == 3 and marked.query("q") == [1.0]
    assert seen == ["passage: a", "passage: b", "passage: c", "query: q"]
    log = []
    behind = index.logged(Toy(), log.append, batch=2)
    assert len(behind.passages(["a", "b", "c"])) == 3 and [r["success"] for r in log] == [True, True]
    failing = Toy()
    failing.passages = lambda texts: 1 / 0
    with pytest.raises(ZeroDivisionError):
        index.logged(failing, log.append).passages(["a"])
    assert not log[-1]["success"]
    index.EMBEDDERS["toy"] = Toy
    assert index.embedder("toy").name == "toy"
    with pytest.raises(KeyError, match="no embedder"):
        index.embedder("other")


def test_streamed_index(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "index")
    for i, pairs in enumerate(([("a", "x"), ("b", "y")], [("a", "xx"), ("b", "y")])):
        index.to_index(spark.createDataFrame(pairs, "id string, text string"), "id", "text", {}).coalesce(1).write.mode("append").parquet(str(source))
        rows = spark.readStream.schema("id string, text string, hash string").parquet(str(source))
        jobs.indexed_stream(rows, path, str(tmp_path / "check"), Toy).awaitTermination()
        assert spark.read.parquet(path).count() == 2 + i
    assert {r.id: r.text for r in jobs.current_index(spark, path).collect()} == {"a": "xx", "b": "y"}


def test_a_text_that_comes_back_and_one_that_goes(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "index")
    seen = []
    for pairs in ([("a", "A"), ("b", "x")], [("a", "B")], [("a", "A")], [("b", None)], [("b", None), ("a", "A")]):
        rows = spark.createDataFrame(pairs, "id string, text string").selectExpr("*", "sha1(text) hash")
        rows.coalesce(1).write.mode("append").parquet(str(source))
        jobs.indexed_stream(spark.readStream.schema("id string, text string, hash string").parquet(str(source)), path, str(tmp_path / "check"), Toy).awaitTermination()
        seen.append({r.id: r.text for r in jobs.current_index(spark, path).collect()})
    assert seen == [{"a": "A", "b": "x"}, {"a": "B", "b": "x"}, {"a": "A", "b": "x"}, {"a": "A"}, {"a": "A"}]
    assert spark.read.parquet(path).count() == 5


def embedded_texts(path):
    return [line for f in sorted(path.glob("*")) for line in f.read_text().split("\n")[:-1]]


def noting(folder, fail_on=()):
    """An embedder that leaves a note of every text it is asked for, and fails on some."""

    class Noting(Toy):
        def passages(self, texts):
            import uuid

            if any(t in fail_on for t in texts):
                raise OSError("gone")
            (folder / uuid.uuid4().hex).write_text("".join(t + "\n" for t in texts))
            return super().passages(texts)

    return Noting


def test_a_build_that_broke_goes_on(spark, tmp_path):
    path, notes = str(tmp_path / "index"), tmp_path / "notes"
    notes.mkdir()
    first = [(f"i{k}", f"text {k}") for k in range(40)]
    assert index.build(indexable(spark, *first), path, noting(notes), steps=4).count() == 40
    assert sorted(embedded_texts(notes)) == sorted(t for _, t in first)
    index.build(indexable(spark, *first), path, noting(notes), steps=4)
    assert index.versions(spark, path) == [1] and len(embedded_texts(notes)) == 40

    changed = [(i, t + "!" if k % 2 else t) for k, (i, t) in enumerate(first[:30])] + [("new", "new text")]
    with pytest.raises(Exception, match="gone"):
        index.build(indexable(spark, *changed), path, noting(notes, {"text 29!"}), steps=4)
    before = len(embedded_texts(notes))
    assert {r.id: r.text for r in index.open_index(spark, path).collect()} == dict(first)
    got = index.build(indexable(spark, *changed), path, noting(notes), steps=4)
    assert {r.id: r.text for r in got.collect()} == dict(changed)
    assert {r.id: r.embedding[0] for r in got.collect()} == {i: float(len(t)) for i, t in changed}
    assert index.versions(spark, path) == [1, 2]
    # nothing that the broken build had finished was asked for again
    assert 40 < before and len(embedded_texts(notes)) == 40 + 16


def test_a_break_between_data_and_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index.build(indexable(spark, ("a", "x"), ("b", "y")), path, Toy)
    with monkeypatch.context() as m:
        m.setattr(index, "commit", lambda *a: (_ for _ in ()).throw(OSError("no commit")))
        with pytest.raises(OSError, match="no commit"):
            index.build(indexable(spark, ("a", "xx"), ("c", "z")), path, Toy)
    assert {r.id: r.text for r in index.open_index(spark, path).collect()} == {"a": "x", "b": "y"}
    assert {r.id: r.text for r in index.build(indexable(spark, ("a", "xx"), ("c", "z")), path, noting(tmp_path, {"xx", "z"})).collect()} == {"a": "xx", "c": "z"}
    assert {r.id: r.text for r in index.open_index(spark, path, 1).collect()} == {"a": "x", "b": "y"}
    with pytest.raises(RuntimeError, match="another build"):
        index.commit(spark, path, 2, {})
    assert index.vacuumed(spark, path, keep=1) > 0
    assert {r.id: r.text for r in index.open_index(spark, path).collect()} == {"a": "xx", "c": "z"} and index.versions(spark, path) == [2]


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"i{k}", "t") for k in range(60)]
    index.build(indexable(spark, *rows), path, Toy, buckets=16)
    old = index.committed(spark, path)["folders"]
    index.build(indexable(spark, ("i7", "other"), *(r for r in rows if r[0] not in ("i7", "i9"))), path, Toy)
    new = index.committed(spark, path)["folders"]
    differ = {b for b in {*old, *new} if old.get(b) != new.get(b)}
    assert 1 <= len(differ) <= 2 and index.open_index(spark, path).count() == 59


def test_repeated_null_and_clashing_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.build(indexable(spark, ("a", "x"), ("a", "x"), (None, "n"), ("b", "y")), path, Toy).count() == 2
    with pytest.raises(ValueError, match="more than one content: a"):
        index.build(indexable(spark, ("a", "x"), ("a", "z")), path, noting(tmp_path, {"x", "z"}))
    assert index.build(indexable(spark), path, Toy).count() == 0 and index.versions(spark, path) == [1, 2]
    wider = index.to_index(spark.createDataFrame([("a", "x", 1)], "id string, text string, k int"), "id", "text", {"k": index.F.col("k")})
    assert index.build(wider, path, Toy).columns == ["id", "text", "k", "hash", "embedding"]


def test_several_rows_of_one_id_in_a_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", "y", 2), ("a", "x", 1), ("b", "u", 1), ("b", None, 3), ("c", "k", None)], "id string, text string, at int").selectExpr("*", "sha1(text) hash")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id string, text string, at int, hash string").parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "again"):  # the second stream runs the same batch once more
        jobs.indexed_stream(source(), path, str(tmp_path / checkpoint), Toy, order="at").awaitTermination()
        assert {r.id: r.text for r in jobs.current_index(spark, path).collect()} == {"a": "y", "c": "k"}
    assert spark.read.parquet(path).count() == 3


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = jobs.windowed_counts(events.withColumn("ts", events.ts.cast("timestamp")))
    assert stream.agg({"events": "sum"}).first()[0] == events.count()


def test_evaluation(spark):
    processes = spark.createDataFrame([("a", "obra de riego", "Lima", "Obras", 5.0, 20260101), ("b", "obra vial", "Lima", "Obras", 50.0, 20260101)], "id string, text string, department string, category string, amount double, day int")
    truth = E.ground_truth(processes, [files.Definition("Q1", "?", {"department": "Lima", "amount_max": 10}, ("obra",), ("vial",)), files.Definition("Q2", "?", {}, ("vial",))])
    assert {tuple(r) for r in truth.collect()} == {("Q1", "a"), ("Q2", "b")}
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([("Q1", [1.0, 0.0]), ("Q2", [1.0, 0.0])], "query_id string, vector array<float>")
    by, summary = E.retrieval_run(corpus, queries, truth.withColumnRenamed("question", "query_id"), (1, 2), ["query_id", "id"])
    assert summary.first().asDict() | {} == {"questions": 2, "mrr": 0.75, "recall_1": 0.5, "precision_1": 0.5, "compliance_1": 0.5, "recall_2": 1.0, "precision_2": 0.5, "compliance_2": 0.5}
    questions = spark.createDataFrame([("P", "x:1,2")], "id string, expected_pages string")
    assert E.expected_pages(questions).count() == 2
    runs = spark.createDataFrame([("m", "q", 1, True, 5.0, 0.1), ("m", "q", 2, False, 5.0, 0.1)], "model string, question string, rank int, hit boolean, latency_ms double, cost double")
    assert E.model_comparison(runs, (1,)).first().mrr == 1.0
    answers = spark.createDataFrame([("1", True, 5.0), ("2", False, 5.03)], "id string, abstained boolean, amount double")
    gold = spark.createDataFrame([("1", True, 5.0), ("2", False, 5.0)], "id string, outside boolean, want double")
    rates, accuracy = E.engine_report(answers, gold, {"amount": ("want", "amount", True)})
    assert rates.first().right_rate == 1.0 and accuracy.first().all_right == 2
    scores = spark.createDataFrame([("1", 0.9, False, False), ("2", 0.2, True, True)], "id string, score double, outside boolean, verdict boolean")
    sweep, options = E.gate_report(scores, [0.5], 0.01)
    assert sweep.first().right == 1 and options.first().calls == 1
    assert E.separation(scores.withColumn("positive", ~scores.outside)).first().auc == 1.0
