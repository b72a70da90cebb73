"""The pipeline, each stage on the rows its predecessor kept."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import decontaminate

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns

    def ids(name, k):
        return [r.doc_id for r in seen[name][k].select("doc_id").collect()]

    for r in seen["quality_rules"][1].collect():
        assert len(brute.words(r.text)) >= 10
    rows = [(r.doc_id, r.text) for r in seen["ngram_jaccard_join"][0].select("doc_id", "text").collect()]
    assert sorted(ids("ngram_jaccard_join", 1)) == sorted({c for _, _, c in brute.jaccard_components(rows, corpus_pipeline.WIDTH, corpus_pipeline.SIMILAR)})
    before, after = seen["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = decontaminate.decontaminate(before, bench).where("contaminated")
    assert sorted(ids("decontamination", 1)) == sorted(set(ids("decontamination", 0)) - {r.doc_id for r in hit.collect()})
    assert set(ids("mixing", 1)) == set(ids("mixing", 0)) and len(ids("mixing", 1)) >= len(ids("mixing", 0))
    assert sorted(ids("sharding", 1)) == sorted(ids("sharding", 0))
    shards = seen["sharding"][1].groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.min("slot").alias("first"))
    assert all(r.first == 0 and r.last == r.n - 1 for r in shards.collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_are_those_from_four_fifths(spark):
    # 41 of 50 shingles shared (82 %) make a near copy, 39 of 50 (78 %) do not
    def text(tag, shared, own, end):
        return " ".join([f"{tag}{k}" for k in range(shared + 4)] + [f"{end}{k}" for k in range(own)])
    rows = [(1, text("s", 41, 9, "a")), (2, text("s", 41, 0, "b")), (3, text("t", 39, 11, "c")), (4, text("t", 39, 0, "d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (corpus_pipeline.WIDTH, corpus_pipeline.SIMILAR) == (5, (80, 100))
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == [1, 3, 4]
