"""Archives of DICOM files: packing, opening, listing and restoring.

An archive is a table of members, a row a file. Files with plain 16-bit pixel data
keep what lies before and behind it and the pixels' two byte planes in columns of
their own; any other file is kept whole. Parquet packs the columns with zstd page by
page, so that headers share what they have in common. Members are dealt by series,
those without one by path, and lie by (series, place, path) within a file of the
table. What is large is spread over tasks by Spark's rebalancing, a series too. A
reader of one series skips what the filter and bounds of a row group or page rule
out. Listing reads no bytes of files.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.operators.stacks import slice_position
from stratavox.sources import dicom

RAW, CODED = "raw", "coded"
MEMBER = ("series", "place", "path", "kind", "modality", "sop_uid", "instance_number", "placed", "rows", "columns", "samples", "value_start", "value_end", "n_bytes", "sha", "error")


def _split(raw: bytes) -> bytes:
    """16-bit samples as the plane of their first bytes and that of their second."""
    return raw[::2] + raw[1::2]


def _joined(planes: bytes) -> bytes:
    raw, half = bytearray(len(planes)), (len(planes) + 1) // 2
    raw[::2], raw[1::2] = planes[:half], planes[half:]
    return bytes(raw)


def _planes(split: bool) -> Column:
    one = _split if split else _joined
    return F.arrow_udf(lambda a: pa.array([None if x is None else one(x) for x in a.to_pylist()], pa.binary()), "binary")


def pack(files: DataFrame) -> DataFrame:
    """Members of files (path, content), in the archive's order; a null content is an empty file.

    Files are made, parsed and moved once, without a table between: no ranges have to be
    drawn first. Digests don't pack, so they and the sizes are made behind the shuffle.
    """
    own = dicom.parsed(files, content=True)
    size = F.col("value_end") - F.col("value_start")
    plain = F.col("error").isNull() & ~F.col("deflated") & F.col("has_pixels") & ~F.col("encapsulated") & (F.col("bits_allocated") == 16)
    samples = F.col("rows").cast("bigint") * F.col("columns") * F.coalesce("samples_per_pixel", F.lit(1)) * F.greatest(F.coalesce("frames", F.lit(1)), F.lit(1))
    coded = F.coalesce(plain & (size == 2 * samples), F.lit(False))
    position = slice_position(F.col("orientation"), F.col("position"))
    known = own.select(
        F.coalesce("series", F.lit("")).alias("series"), F.coalesce(position, F.col("instance_number"), F.lit(0)).cast("bigint").alias("place"), "path", F.when(coded, CODED).otherwise(RAW).alias("kind"), "modality", "sop_uid", "instance_number", position.isNotNull().alias("placed"),
        "rows", "columns", "value_start", "value_end", "error", "content", F.when(F.col("series").isNull(), F.crc32("path")).alias("alone"),
    )
    known = known.hint("rebalance", "series", "alone").sortWithinPartitions("series", "place", "path")
    known = known.withColumns({"samples": F.when(F.col("kind") == CODED, F.shiftright(size, 1)), "n_bytes": F.octet_length("content").cast("bigint"), "sha": F.sha2("content", 256)})
    part = lambda start, length: F.when(F.col("kind") == CODED, F.substring("content", start, length))
    at = lambda name: F.col(name).cast("int")
    whole = F.when(F.col("kind") == RAW, F.col("content"))
    head, tail = F.coalesce(part(F.lit(1), at("value_start")), whole), part(at("value_end") + 1, at("n_bytes"))
    return known.select(*MEMBER, head.alias("head"), _planes(True)(part(at("value_start") + 1, at("value_end") - at("value_start"))).alias("pixels"), tail.alias("tail"))


def write(members: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    options = {"compression": "zstd", "parquet.bloom.filter.enabled#series": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    members.write.mode(mode).options(**options).parquet(folder)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """Members of a written archive, with `invalid`: why a record can't stand, or null."""
    size, start, end = F.col("n_bytes"), F.col("value_start"), F.col("value_end")
    invalid = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "no path").when(size.isNull() | (size < 0), "no size").when(~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no digest")
        .when(~F.coalesce(F.col("kind").isin(RAW, CODED), F.lit(False)), "unknown kind").when((F.col("kind") == CODED) & ~F.coalesce((start >= 0) & (start <= end) & (end <= size), F.lit(False)), "pixels beyond the file")
        .when((F.col("kind") == CODED) & ~F.coalesce(end - start == 2 * F.col("samples"), F.lit(False)), "layout differs from the pixels")
    )
    return spark.read.parquet(folder).withColumn("invalid", invalid)


def listing(archive: DataFrame) -> DataFrame:
    """What an archive holds, by series: its coded members, those with a place, and their bytes."""
    own = archive.where((F.col("kind") == CODED) & F.col("invalid").isNull())
    return own.groupBy("series").agg(F.count("*").alias("n_instances"), F.count_if("placed").alias("n_placed"), F.sum("n_bytes").alias("bytes"))


def restore(archive: DataFrame) -> DataFrame:
    """Files (series, path, content, ok): ok tells whether the bytes have the member's digest; else content is null."""
    none = F.unhex(F.lit(""))
    kept = F.col("invalid").isNull()
    pixels = F.when(kept & (F.col("kind") == CODED), _planes(False)(F.col("pixels")))
    rest = F.when(F.col("kind") == CODED, F.concat(pixels, F.col("tail"))).otherwise(none)
    content = F.concat(F.col("head"), rest)
    ok = F.coalesce(kept & (F.sha2(content, 256) == F.col("sha")), F.lit(False))
    return archive.select("series", "path", "kind", content.alias("content"), ok.alias("ok")).withColumn("content", F.when(F.col("ok"), F.col("content")))
