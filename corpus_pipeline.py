"""A corpus pipeline: quality, near-duplicates, contamination, personal data, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last keep
the columns of documents. Null ids, texts and extra columns pass through; a null
or empty text is rejected by the quality rules, as it has too few words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm import decontaminate, pieces, pii, quality, simhash_wide
from stratavox.llm._common import bound_batches, fresh, shared_folder, table

#: Sampling and the fitted thresholds of PII terms aren't SQL; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash segments of 5-word shingles, similarity 0.8 checked on the shingles): the one with the smallest doc_id."""
    bound_batches(spark)
    return simhash_wide.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    bound_batches(spark)
    mark = fresh(docs, "contamination")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=mark)
    return marked.where(~F.col(f"{mark}.contaminated")).drop(mark)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts."""
    bound_batches(spark)
    return pii.sanitise(docs)


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the pieces of the likeliest-drawn segmentation and the figures of all samples."""
    bound_batches(spark)
    drawn = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), pieces.sample(F.col("text"), F.col("doc_id"), pieces.model_path(spark)).alias("s"))
    return drawn.select("doc_id", "n_bytes", F.element_at("s", 1)["ids"].alias("pieces"), F.transform("s", lambda x: F.size(x["ids"])).alias("n_pieces"), F.transform("s", lambda x: x["log_prob"]).alias("log_prob"), F.transform("s", lambda x: x["log_inclusion"]).alias("log_inclusion"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("tokenise", tokenise_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others keep is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
