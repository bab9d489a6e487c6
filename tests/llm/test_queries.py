"""The registered queries against SQL on the small tables, and the pipeline's stages."""

import pytest

import corpus_pipeline
from fleetsift.llm import quality_classifier, quality_rules
from fleetsift.llm.queries import ORACLE, QUERIES
from verification.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    mine, theirs, difference = differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name])
    assert difference is None and mine == theirs > 0


def test_thirteen_operators():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, SF_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) == docs.count()
        if name == "quality_classifier":
            model = quality_classifier.train(before, quality_classifier.grades(spark.read.parquet(f"{SF_DIR}/labels.parquet")))
            assert now == {r.doc_id for r in quality_classifier.score(before, model, 2).where("kept").collect()}
        if name == "quality_rules":
            rules = quality_rules.train(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            assert now == {r.doc_id for r in quality_rules.judge(before, rules).collect() if r.kept}
        if name != "sentencepiece":
            assert docs.columns == columns
        else:
            assert docs.where("round_trip").count() == docs.count() > 0
        ids = now
