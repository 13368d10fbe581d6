"""The corpus pipeline: every stage acts, stages chain, and run() equals the chain."""

import random

import corpus_pipeline
from aeris.llm import decontamination, pii, simhash, toxicity
from tests.conftest import SMOKE_DIR
from tests.llm import frames


def test_stages_chain_and_act(spark, tmp_path):
    docs = frames.smoke(spark)
    labels, benchmark = frames.smoke(spark, "labels"), frames.smoke(spark, "benchmark")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SMOKE_DIR).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").distinct().collect()}
        if name == "toxicity":
            wanted = toxicity.scored(before, labels).where("predicted = 0")
        elif name == "near_duplicates":
            wanted = simhash.simhash_components(before).select("component_id").distinct().withColumnRenamed(
                "component_id", "doc_id")
        elif name == "decontamination":
            wanted = decontamination.contamination(before, benchmark).where("not contaminated")
        else:
            wanted = before
        assert ids == {r["doc_id"] for r in wanted.select("doc_id").collect()}
        if name == "personal_data":
            left = pii.digested(after).agg({"n_email": "sum", "n_ip": "sum"}).first()
            assert list(left) == [0, 0]
        before = after
    whole = corpus_pipeline.run(spark, SMOKE_DIR)
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(
        r["doc_id"] for r in before.select("doc_id").collect())


def test_stages_on_edge_rows(spark, tmp_path):
    docs = frames.documents(spark, frames.edge_rows())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMOKE_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 0
    none = frames.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMOKE_DIR).count() == 0


def test_exact_copies_leave_one(spark):
    rng = random.Random(0)
    text = frames.sentence(rng, 80)
    docs = frames.documents(spark, [(i, text) for i in range(50)] + [(99, frames.sentence(rng, 80))])
    kept = corpus_pipeline.near_duplicates(spark, docs, SMOKE_DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 99]
