"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it uses its warehouse, a cluster must set it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/tables"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own: what reads it prunes columns and row groups."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
