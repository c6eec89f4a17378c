"""The five stages on the smallest tables."""

import cases

import __spark_entry__ as entry
import corpus_pipeline
from spanloom.llm import decontam


def test_stages(spark):
    docs, before = spark.read.parquet(f"{cases.SF}/documents.parquet"), None
    columns, counts = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, cases.SF)
        before, docs = docs, spark.createDataFrame(result.collect(), result.schema)
        if n < 4:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    assert decontam.overlaps(before, spark.read.parquet(f"{cases.SF}/benchmark.parquet")).count() == 0
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"](spark, cases.SF).count() > 0
    assert "pipeline" not in entry.oracle_sql()


def test_odd_rows(spark):
    for df in (cases.odd(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, cases.SF)
            if name != "best_fit_packing":
                assert out.columns == df.columns and out.count() <= df.count(), name
            else:
                assert out.filter("piece = 0").count() == df.count()
