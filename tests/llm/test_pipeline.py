"""The five stages one after the other, and the whole against its stages."""

import corpus_pipeline
from colloquy.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[5] > 0
    whole = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_empty(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), f"empty-{name}")
    assert docs.count() == 0


def test_two_runs_do_not_touch_each_other(spark):
    one, two = corpus_pipeline.run(spark, DATA), corpus_pipeline.run(spark, DATA)
    assert two.count() == one.count() > 0
