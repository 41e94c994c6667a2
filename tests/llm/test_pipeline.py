import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose, row
from tests.llm.test_decontaminate import plain
from tests.llm.test_tokens_and_packing import check_packing
from tests.oracle import assert_same, connect
from tidewell.llm import pii
from tidewell.llm.queries import ORACLES, QUERIES


def test_stages_and_run_agree(spark, sf_dir, documents):
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
            docs = spark.createDataFrame(docs.collect(), before.schema)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ran = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, ran.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_each_decision_takes_effect(spark, sf_dir, documents):
    stages = dict(corpus_pipeline.STAGES)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, documents, sf_dir)
    want = plain({r.doc_id: r.text for r in documents.collect()}, items)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    hidden = stages["pii"](spark, documents, sf_dir).collect()
    assert not any(pii.base_spans(r.text) for r in hidden) and all(r.n_chars == len(r.text) for r in hidden)
    once = stages["near_dedup"](spark, documents, sf_dir)
    assert once.count() == once.select("text").distinct().count()
    packed = stages["packing"](spark, documents, sf_dir).collect()
    check_packing(packed, {}, 4096)
    rude = spark.createDataFrame([row(10**6, prose(80) + " idiot moron scum trash idiot moron")], "doc_id long, text string, lang string, source string, n_chars long, a long, b long, c long, d string, e int, f int, g string, h int, i string, j string, k long").select(documents.columns)
    kept = stages["toxicity"](spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(rude), "/root/testdata/sf0.01")
    assert kept.where(F.col("doc_id") == 10**6).count() == 0 and kept.count() > 800


def test_stages_on_edges(spark, sf_dir, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
        assert stage(spark, edge, sf_dir).count() > 0, name


def test_queries_are_the_thirteen(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert public_tokenizers.path("word_bpe_49k.json") not in str(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLES[name]))
