"""Integer networks over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators import network as N
from stratavox.plans.registry import query, table

WIDE, MID, OUT = 64, 48, 6
LAYERS = [N.formula_layer(WIDE, MID, True), N.formula_layer(MID, MID, True), N.formula_layer(MID, OUT, False)]


def _inputs(c: str = "embedding") -> Column:
    """The components of a vector as int8."""
    return F.transform(c, lambda e: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(e.cast("double") * 256).cast("int"))))


_IN = f"i AS (SELECT vec_id, list_transform(embedding, lambda e: greatest(-128, least(127, floor(e::DOUBLE * 256)::INT))) AS x0 FROM embeddings)"


def _layer_sql(source: str, x: str, inputs: int, outputs: int, hidden: bool) -> str:
    w = f"CASE WHEN (o * {inputs} + k) * 37 % 255 > 127 THEN (o * {inputs} + k) * 37 % 255 - 256 ELSE (o * {inputs} + k) * 37 % 255 END"
    acc = f"100 + list_sum(list_transform(range(0, {inputs}), lambda k: {x}[k + 1]::BIGINT * ({w})))::BIGINT"
    value = f"greatest(0, least(127, ({acc} + 256) >> 9))::BIGINT" if hidden else acc
    return f"SELECT vec_id, list_transform(range(0, {outputs}), lambda o: {value}) AS y FROM {source}"


@query("dense_hidden", f"WITH {_IN}, l1 AS ({_layer_sql('i', 'x0', WIDE, MID, True)}) SELECT vec_id, y FROM l1")
def dense_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hidden layer: products, bias, rounding shift, clamp to 0..127."""
    return table(spark, sf_dir, "embeddings").select("vec_id", N.forward_column(_inputs(), LAYERS[:1]).alias("y"))


@query("dense_linear", f"WITH {_IN}, l1 AS ({_layer_sql('i', 'x0', WIDE, OUT, False)}) SELECT vec_id, y FROM l1")
def dense_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear layer in column functions: raw accumulators."""
    return table(spark, sf_dir, "embeddings").select("vec_id", N.dense(_inputs(), N.formula_layer(WIDE, OUT, False)).alias("y"))


@query("mlp_forward", f"WITH {_IN}, l1 AS ({_layer_sql('i', 'x0', WIDE, MID, True)}), l2 AS ({_layer_sql('l1', 'y', MID, MID, True)}), l3 AS ({_layer_sql('l2', 'y', MID, OUT, False)}) SELECT vec_id, y FROM l3")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-48-48-6 network over all vectors, in Arrow batches."""
    return table(spark, sf_dir, "embeddings").select("vec_id", N.forward_column(_inputs(), LAYERS).alias("y"))


@query("overflow_bound", "WITH w AS (SELECT label, i, abs(greatest(-128, least(127, floor(embedding[i]::DOUBLE * 256)::INT))) AS w FROM embeddings, range(1, 65) t(i)), r AS (SELECT label, i, sum(w)::BIGINT AS s FROM w GROUP BY ALL) SELECT label, max(100 + s * 128)::BIGINT AS bound, max(100 + s * 128) <= 1073741824 AS safe FROM r GROUP BY label")
def overflow_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators' bounds of layers whose weights are the vectors of a label."""
    w = F.transform("embedding", lambda e: F.abs(F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(e.cast("double") * 256).cast("int")))))
    own = table(spark, sf_dir, "embeddings").select("label", F.posexplode(w).alias("i", "w")).groupBy("label", "i").agg(F.sum("w").alias("s"))
    return own.groupBy("label").agg(F.max(100 + F.col("s") * 128).alias("bound")).withColumn("safe", F.col("bound") <= N.LIMIT)


def bounds_of(layers: list[N.Layer]) -> list[int]:
    return [int(np.max(N.overflow_bound(x))) for x in layers]
