import re

import corpus_pipeline
from tests.llm.cases import documents, empty, prose


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns, name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
    # junk went, one of the copies stayed
    assert not {r.doc_id for r in got} & {0, 1, 2, 18} and len({r.doc_id for r in got} & {5, 6, 7}) <= 1


def test_each_stage_alone(spark):
    words = lambda df: sum(len(re.findall(r"\S+", r.text)) for r in df.collect())
    clean = spark.createDataFrame([(i, prose(i, 60), "en", f"s{i % 3}", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality classifier", "line dedup", "MinHash near-dedup"):
        assert stages[name](spark, clean, "").count() == 30, name
    mixed = stages["mixing sources"](spark, clean, "")
    assert abs(words(mixed) - 1800) <= 60


def test_empty(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50
