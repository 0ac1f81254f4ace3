"""Typed scans of result tables (CSV) and series lists (JSON).

Rows that don't fit the schema are kept with what they held in `bad`, so that a
damaged file can't pass for a shorter one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "id string, codec string, modality string, bytes bigint, raw bigint, encode_s double, decode_s double, lossless boolean, bad string"
#: Field names of the catalogue's answers (fixed values).
SERIES = "SeriesInstanceUID string, PatientID string, Collection string, Modality string, ImageCount string, LicenseName string, CollectionURI string, bad string"


def results(spark: SparkSession, path: str) -> DataFrame:
    """Codec results of CSV files with a header; the last row of an (id, codec) isn't singled out."""
    return spark.read.schema(RESULT).option("header", True).option("columnNameOfCorruptRecord", "bad").csv(path)


def series(spark: SparkSession, path: str) -> DataFrame:
    """Series of JSON lines or arrays: uid, patient, collection, modality, images (0 where unknown), license, doi, bad."""
    raw = spark.read.schema(SERIES).option("columnNameOfCorruptRecord", "bad").json(path)
    images = F.coalesce(F.expr("try_cast(ImageCount AS int)"), F.lit(0))
    return raw.select(F.col("SeriesInstanceUID").alias("uid"), F.col("PatientID").alias("patient"), F.col("Collection").alias("collection"), F.col("Modality").alias("modality"), images.alias("images"), F.coalesce("LicenseName", F.lit("")).alias("license"), F.coalesce("CollectionURI", F.lit("")).alias("doi"), "bad")
