"""The numbered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lmscore, pieces, pii, quality, simhash, toxicity, warc
from ._common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_log_score", F.round("mean_log_score", 4))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "contamination.n_words", "contamination.n_hit", "contamination.n_items", "contamination.items_sha256", "contamination.contaminated")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), F.col("text"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("p"))
    return scored.select("doc_id", "held_out", "p.score", (F.col("p.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("p.evidence.doc_id").alias("evidence"))


def op8_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.model_path(spark)
    drawn = table(spark, sf_dir, "documents").select("doc_id", "text", pieces.sample(F.col("text"), F.col("doc_id"), model).alias("s"))
    of = lambda name, f: F.transform("s", f).alias(name)
    checked = drawn.withColumn("n_decoded", pieces.n_decoded(F.col("text"), F.col("s"), model))
    return checked.select("doc_id", F.size("s").cast("bigint").alias("n_samples"), "n_decoded", of("n_pieces", lambda x: F.size(x["ids"])), of("digest", lambda x: F.xxhash64(x["ids"])), of("log_prob", lambda x: x["log_prob"]), of("log_inclusion", lambda x: x["log_inclusion"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op4_langid": op4_langid,
    "op5_simhash": op5_simhash,
    "op6_warc_audit": op6_warc_audit,
    "op7_toxicity": op7_toxicity,
    "op8_sample_pieces": op8_sample_pieces,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
}
ORACLE: dict[str, str] = {
    "op1_lm_score": lmscore.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op6_warc_audit": warc.ORACLE,
}
