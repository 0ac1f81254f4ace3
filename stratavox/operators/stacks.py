"""Files classified, grouped into stacks and ordered, as the packer needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratavox.functions.integers import big, shift_left, shift_right

#: Modalities whose images are projections, never coded from one slice to the next (fixed values).
PROJECTIONS = ("CR", "DX", "MG", "RF", "XA", "PX", "IO")
KEY = ("series", "rows", "columns", "bits_stored", "signed", "orientation", "multiframe")


def classify() -> Column:
    """The first reason, in order, why a parsed file is stored as it is; null if its pixels are coded."""
    return (
        F.when(F.col("error").isNotNull(), "unparsable").when(F.col("deflated"), "deflated").when(F.col("float_pixels"), "float_pixels")
        .when(~F.col("has_pixels"), "no_pixel_data").when(F.col("encapsulated"), "encapsulated").when(F.col("layout_error").isNotNull(), "layout")
    )


def layout(samples: Column, rows: Column, columns: Column, allocated: Column, stored: Column, high: Column, representation: Column, frames: Column) -> dict[str, Column]:
    """Layout of native pixel data with its defaults, and the first error that makes it unusable."""
    bits = F.coalesce(stored, allocated)
    top = F.coalesce(high, F.greatest(bits - 1, F.lit(0)))
    error = (
        F.when(F.coalesce(samples, F.lit(1)) != 1, "more than one sample per pixel").when(rows.isNull(), "Rows").when(columns.isNull(), "Columns").when(allocated.isNull(), "BitsAllocated")
        .when(~allocated.isin(8, 16), "bits allocated other than 8 or 16").when((bits == 0) | (bits > allocated) | (top >= allocated) | (top + 1 < bits), "inconsistent bits stored and high bit")
        .when((rows == 0) | (columns == 0), "empty frame")
    )
    return {"bits_stored": bits, "high_bit": top, "signed": F.coalesce(representation == 1, F.lit(False)), "frames": F.greatest(F.coalesce(frames, F.lit(1)), F.lit(1)), "layout_error": error}


def slice_position(orientation: Column, position: Column) -> Column:
    """Place along the slice's normal in 1/10000 mm; null unless both are known and finite."""
    o, p = (lambda i: F.get(orientation, i)), (lambda i: F.get(position, i))
    n = (o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3))
    d = n[0] * p(0) + n[1] * p(1) + n[2] * p(2)
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), F.round(d * 1e4).cast("bigint"))


def stack_ids(members: DataFrame) -> DataFrame:
    """members with their stack's number: the rank of its key, series by series.

    Ranks run within a series and series are counted from few rows: the number
    of stacks of every series, not its members.
    """
    keys = members.select(*KEY).distinct()
    order = [F.col(k).asc_nulls_first() for k in KEY[1:]]
    own = keys.withColumn("in_series", F.row_number().over(Window.partitionBy("series").orderBy(*order)) - 1)
    size = own.groupBy("series").agg(F.count("*").alias("n"))
    base = size.select("series", (F.sum("n").over(Window.orderBy("series").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    numbered = own.join(base, "series").select(*KEY, (F.col("base") + F.col("in_series")).alias("stack"))
    on = [members[k].eqNullSafe(numbered[k]) for k in KEY]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return members.join(numbered, cond).select(members["*"], numbered["stack"])


def stack_order(members: DataFrame) -> DataFrame:
    """members with order in the stack, first_slice and whether the stack is coherent (slices may predict each other)."""
    by = Window.partitionBy(*KEY)
    place = by.orderBy(F.coalesce("position", F.lit(-(1 << 63))), F.coalesce("instance_number", F.lit(0)), F.coalesce("sop_uid", F.lit("")), "idx")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    return (
        members.withColumn("order", (F.row_number().over(place) - 1).cast("bigint")).withColumn("first_slice", F.sum(big(F.col("frames"))).over(upto) - F.col("frames"))
        .withColumn("coherent", (F.count("*").over(by) == 1) | F.every(F.col("position").isNotNull()).over(by))
    )


def decode_cell(cell: Column, bits: Column, high: Column, signed: Column) -> Column:
    """The stored value of a pixel cell."""
    one, shift = shift_left(1, bits.cast("int")), (high + 1 - bits).cast("int")
    raw = shift_right(cell, shift).bitwiseAND(one - 1)
    return F.when(signed & (raw >= shift_right(one, 1)), raw - one).otherwise(raw)


def encode_cell(value: Column, allocated: Column, bits: Column, high: Column, sign: bool) -> Column:
    """The cell of a value with zeros around it, or with its sign above it."""
    zero = shift_left(big(value).bitwiseAND(shift_left(1, bits.cast("int")) - 1), (high + 1 - bits).cast("int"))
    if not sign:
        return zero
    above = shift_left(1, allocated.cast("int")) - shift_left(1, (high + 1).cast("int"))
    return F.when(value < 0, zero.bitwiseOR(above)).otherwise(zero)


def slice_spacing(first: Column, second: Column) -> Column:
    """Distance of the positions of a stack's first two slices; null unless both are known."""
    squares = F.zip_with(first, second, lambda a, b: (b - a) * (b - a))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
