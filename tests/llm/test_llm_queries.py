"""Registered queries over a whole small table, and the pipeline."""

import pytest
from compare import connect, oracle_rows, rows_of

import corpus_pipeline
from tessella.llm import queries, sql

QUERIES, SQL = queries.queries(), sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, got = rows_of(df)
    if name in SQL:
        wanted_names, wanted = oracle_rows(connect(sf_dir), SQL[name])
        assert names == wanted_names and got == wanted
    else:
        assert got


def test_held_out_accuracy(spark, sf_dir):
    large = sf_dir.replace("0.001", "0.01")
    out = QUERIES["op1_quality_classifier"](spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out")
    right, n = out.selectExpr("sum(cast(predicted = quality AS int))", "count(*)").first()
    assert right >= 0.95 * n


def test_pipeline_stages_follow_from_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
        docs = out
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.count() == docs.count() and final.where("NOT lossless").isEmpty()
    assert final.where("n_tokens <> size(ids)").isEmpty()
