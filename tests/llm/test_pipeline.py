"""The pipeline's stages against plain versions, and the registered SQL."""

import hashlib
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from compare import connect, rows_of, sql_rows
from stratavox.llm import queries as Q
from stratavox.llm import pieces, quality
from test_simhash_wide import brute

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    names, want = sql_rows(connect(DATA), Q.ORACLE[name])
    assert sorted(df.columns) == names and rows_of(df) == want


def test_audit_query_names_the_rotten_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    rotten = {r["page_id"] for r in pages if hashlib.md5(str(r["page_id"]).encode()).hexdigest() < "07" and "<" in (r["html"] or "")}
    assert {r["page_id"] for r in Q.op6_warc_audit(spark, DATA).collect()} == rotten


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.withColumns({"kept": F.lit(1), "fp": F.lit("x"), "root": F.lit(2), "contamination": F.lit(3), "th": F.lit(4)})
    schema = ", ".join(f"{n} {k}" for n, k in extra.dtypes)
    nulls = spark.createDataFrame([(None,) * len(extra.columns)] * 2, schema)
    own = extra.unionByName(nulls).unionByName(extra.limit(3))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        before = own.collect()
        own = stage(spark, own, DATA)
        assert own.columns == extra.columns
        own.write.parquet(str(tmp_path / str(k)))
        own = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            kept = {(r["doc_id"], r["n_words"]) for r in quality.query(spark.createDataFrame(before, schema)).where("kept").collect()}
            assert {r["doc_id"] for r in own.collect()} == {i for i, _ in kept} and own.count() <= len(before)
        if k == 1:
            assert sorted(r["doc_id"] for r in own.collect()) == brute([(r["doc_id"], r["text"]) for r in before])
        if k == 2:
            marked = {r["doc_id"]: r["contaminated"] for r in Q.op2_decontaminate(spark, DATA).collect()}
            assert sorted(r["doc_id"] for r in own.collect()) == sorted(r["doc_id"] for r in before if not marked[r["doc_id"]])
        if k == 3:
            assert own.count() == len(before)
            assert not any("@example" in r["text"] for r in own.collect())
    last = P.STAGES[-1][1](spark, own, DATA)
    assert last.count() == own.count() and texts


def test_empty_tables(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_run_and_guard(spark):
    rows = P.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    v = pieces.vocabulary(pieces.model_path(spark))
    assert {r["doc_id"]: pieces.decode_ids(v, r["pieces"]) for r in rows} == texts
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_lm_score" in entry.oracle_sql()
    assert "corpus_pipeline" in sys.modules
