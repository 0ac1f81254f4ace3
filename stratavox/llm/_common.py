"""Session helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to a Python worker: bound a worker's memory when texts are long.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20
#: A split of rows by crc32(doc_id as text): remainder 2 of 4 is held out.
HELD_OUT = (4, 2)


def bound_batches(spark: SparkSession) -> None:
    """Sets the size of an Arrow batch for the session: every query and stage does so before it plans."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """The place of a public tokenizer's file on every machine; its folder is the setting stratavox.tokenizers."""
    return f"{spark.conf.get('stratavox.tokenizers', '/opt/tokenizers')}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (driver and executors in one process)
    gets a folder under its warehouse; on a cluster it is an error, as a folder of
    one machine would lose the data.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(place)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def once(udf: Callable[..., Column]) -> Callable[..., Column]:
    """udf, evaluated once a row even where a filter or an explode reads its column.

    Spark copies a deterministic UDF into the filter that it pushes below; then each
    task assesses its rows twice, in two Python workers that both hold the models.
    """
    return udf.asNondeterministic()


_MODEL: dict[tuple, object] = {}


def kept_model[T](make: Callable[..., T], *key: str) -> T:
    """make(*key), kept for the next batches in place of the model kept before: a worker outlives its stage, and the models of all operators would add up."""
    if (make, *key) not in _MODEL:
        _MODEL.clear()
        _MODEL[make, *key] = make(*key)
    return _MODEL[make, *key]


def held_out(doc_id: Column) -> Column:
    """True if the row belongs to the held-out fold; false for a null id."""
    mod, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """True if labels of the row may be learned from; false for a null id."""
    mod, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod != rest, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
