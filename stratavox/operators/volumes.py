"""Volumes as rows of sample arrays, their statistics and value mappings.

The row form (volume columns, z, y, s ARRAY<INT>) carries a row of samples per
record: what is wide in a volume stays an array, so that windows and joins move
one record per row, and samples are only exploded where each is aggregated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.functions.integers import div

#: Histogram packing pays if at least this span is used to less than three quarters.
MIN_PACKED_SPAN = 64


def embedding_rows(embeddings: DataFrame, rows_per_slice: int = 50, step: int = 1) -> DataFrame:
    """Vectors as the rows of one signed 12-bit volume: (z, y, s); step > 1 leaves gaps between its values."""
    value = lambda e: F.greatest(F.lit(-2048), F.least(F.lit(2047), F.floor(e.cast("double") * 1000).cast("int"))) * step
    return embeddings.select(div(F.col("vec_id"), rows_per_slice).cast("int").alias("z"), (F.col("vec_id") % rows_per_slice).cast("int").alias("y"), F.transform("embedding", value).alias("s"))


def explode_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """The long form: keys, z, y, x, v."""
    return rows.select(*keys, "z", "y", F.posexplode("s").alias("x", "v"))


def in_range(v: Column, lo: Column | int, hi: Column | int) -> Column:
    return v.between(lo, hi)


def value_stats(samples: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """Exact extent, distinct count and packing decision of each volume.

    Distinct values are found by a first aggregation over (keys, value), whose
    partial results bound the shuffle to the distinct values of each task.
    """
    v = F.col(value)
    per = samples.groupBy(*keys, v.alias("v")).agg(F.count("*").alias("n"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n_distinct"))
    span = (F.col("hi") - F.col("lo")).cast("bigint")
    packed = (span >= MIN_PACKED_SPAN) & (F.col("n_distinct") * 4 < (span + 1) * 3)
    return out.withColumn("span", span).withColumn("packed", packed).withColumn("max_mapped", F.when(packed, F.col("n_distinct") - 1).otherwise(span))


def rank_dictionary(samples: DataFrame, *keys: str, value: str = "v") -> DataFrame:
    """(keys, v, rank): the place of every value among the values present.

    The window runs over distinct values of at most 16 bits, 65,536 a volume.
    """
    own = samples.select(*keys, F.col(value).alias("v")).distinct()
    return own.withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1).cast("bigint"))


def tiles(depth: Column, height: Column, slab: int, stripe: int) -> Column:
    """All tiles of a volume as array<struct>: slabs outer, stripes inner, the last ones clipped."""
    n_slabs, n_stripes = div(depth + (slab - 1), slab), div(height + (stripe - 1), stripe)

    def one(i: Column) -> Column:
        a, b = div(i, n_stripes), i % n_stripes
        return F.struct(i.alias("tile"), a.alias("slab"), b.alias("stripe"), (a * slab).alias("z0"), (b * stripe).alias("y0"), F.least(F.lit(slab), depth - a * slab).cast("bigint").alias("depth"), F.least(F.lit(stripe), height - b * stripe).cast("bigint").alias("height"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), n_slabs * n_stripes - 1), one)


def with_tile(rows: DataFrame, slab: int, stripe: int) -> DataFrame:
    return rows.withColumn("slab", div(F.col("z"), slab).cast("int")).withColumn("stripe", div(F.col("y"), stripe).cast("int"))


def central_window(z: Column, n: Column, depth: int) -> Column:
    """True for the depth slices in the middle of n."""
    lo = div(F.greatest(n - depth, F.lit(0)), 2)
    return (z >= lo) & (z < lo + depth)


def from_numpy(spark: SparkSession, array: np.ndarray, volume_id: str, bits: int) -> DataFrame:
    """Rows (volume_id, z, y, s) of a 2-D or 3-D array; samples outside the bits are an error that names the first."""
    t = array[None] if array.ndim == 2 else array
    if t.ndim != 3 or 0 in t.shape:
        raise ValueError(f"shape {array.shape}")
    signed = t.dtype.kind == "i"
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    if len(bad := np.argwhere((t < lo) | (t > hi))):
        raise ValueError(f"value {t[tuple(bad[0])]} outside [{lo}, {hi}]")
    rows = [(volume_id, z, y, t[z, y].tolist()) for z in range(t.shape[0]) for y in range(t.shape[1])]
    return spark.createDataFrame(rows, "volume_id string, z int, y int, s array<int>")


def to_numpy(rows: DataFrame) -> np.ndarray:
    """The array (z, y, x) of one volume's rows: for volumes that fit the driver."""
    got = sorted((r["z"], r["y"], r["s"]) for r in rows.select("z", "y", "s").toLocalIterator())
    depth = len({z for z, _, _ in got})
    return np.array([s for _, _, s in got]).reshape(depth, -1, len(got[0][2]))
