"""The query registry: name -> f(spark, sf_dir), and SQL of the same rows where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("volume", "context", "entropy", "network", "stacks", "index", "evaluation", "protocol", "files")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


#: Rows and bytes in one Arrow batch handed to a Python worker: a worker's memory doesn't grow with the rows of its task.
ARROW_ROWS, ARROW_BYTES = 4096, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; sets the session's Arrow batches, before the query is planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"stratavox.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
