"""A task of the pipeline assesses its rows once, in one Python worker that holds one operator's models."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from stratavox.llm import _common, decontaminate, pii, quality

DATA = "/root/testdata/sf0.001"


def evaluations(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("stage", [quality, pii, decontaminate])
def test_rows_are_evaluated_once(spark, monkeypatch, stage):
    docs, written = _common.table(spark, DATA, "documents"), []
    monkeypatch.setattr(quality, "cut", lambda df: written.append(df) or _common.cut(df))
    monkeypatch.setattr(pii, "cut", lambda df: written.append(df) or _common.cut(df))
    if stage is quality:
        written.append(P.quality_stage(spark, docs, DATA))
    elif stage is pii:
        written.append(P.pii_stage(spark, docs, DATA))
    else:
        written += [decontaminate.benchmark_windows(_common.table(spark, DATA, "benchmark")), P.decontamination_stage(spark, docs, DATA)]
    assert max(map(evaluations, written)) == 1


def test_figures_under_a_filter_are_the_same(spark):
    docs = _common.table(spark, DATA, "documents")
    rows = docs.select("doc_id", quality.figures(F.col("text"), quality.vocabularies(docs)).alias("f"))
    every = {r["doc_id"]: r["f"] for r in rows.collect()}
    some = {r["doc_id"]: r["f"] for r in rows.where(~F.col("f.base_failed")).collect()}
    assert some == {d: f for d, f in every.items() if not f["base_failed"]} and some


def test_a_worker_keeps_one_model():
    made = []
    make = lambda *key: made.append(key) or len(made)
    assert [_common.kept_model(make, k) for k in ("a", "a", "b", "b", "a")] == [1, 1, 2, 2, 3]
