"""Tile streams, file sources, archives and their verification."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.digests import zstd_compress, zstd_decompress
from stratavox.operators import archive as A
from stratavox.operators import codec as K
from stratavox.operators import stacks as S
from stratavox.plans.context import UNTRAINED, untrained
from stratavox.plans.registry import query, table
from stratavox.plans.volume import VOL, rows
from stratavox.sources import arrays, dicom
from stratavox.sources.storage import shared_folder, written


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.encode(rows(spark, sf_dir).withColumn("volume_id", F.lit("embeddings")), slab=4, stripe=16)


def _by_slice(df: DataFrame) -> DataFrame:
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return df.groupBy("z").agg(F.count("*").alias("n_rows"), F.sum(total * (F.col("y") + 1)).alias("weighted"), F.every("ok").alias("ok"))


_SLICES = f"WITH {VOL} SELECT z, count(DISTINCT y)::BIGINT AS n_rows, sum(v * (y + 1))::BIGINT AS weighted, true AS ok FROM vol"


@query("encode_tiles")
def encode_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile streams of the embedding volume with their places; bytes depend on the compressor's version."""
    return K.with_offsets(tiles(spark, sf_dir)).select("volume_id", "slab", "stripe", "depth", "height", "width", "begin", "length", "samples_crc")


@query("decode_roundtrip", _SLICES + " GROUP BY z")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All slices decoded from their tiles, with checksums verified."""
    return _by_slice(K.decode(tiles(spark, sf_dir)))


@query("decode_slices", _SLICES + " WHERE z >= 3 AND z < 6 GROUP BY z")
def decode_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices 3 to 5 of a written volume: tiles of other slabs are neither read nor decoded."""
    return _by_slice(K.decode_slices(written(tiles(spark, sf_dir), "tiles"), 3, 6, slab=4))


@query("inspect", f"WITH {VOL}, t AS (SELECT DISTINCT z // 4 AS slab, y // 16 AS stripe FROM vol) SELECT 'embeddings' AS volume_id, (SELECT count(*) FROM t)::BIGINT AS n_tiles, max(z // 4 + 1)::INT AS slabs, max(y // 16 + 1)::INT AS stripes, count(*)::BIGINT AS n_samples, min(v)::INT AS lo FROM vol")
def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written tile table says of a volume: its streams are not read."""
    t = written(tiles(spark, sf_dir), "tiles").drop("stream")
    return t.groupBy("volume_id").agg(F.count("*").alias("n_tiles"), (F.max("slab") + 1).alias("slabs"), (F.max("stripe") + 1).alias("stripes"), F.sum(F.coalesce(F.array_size("present"), F.col("depth") * F.col("height")).cast("bigint") * F.col("width")).alias("n_samples"), F.min("lo").alias("lo"))


@query("trace", f"WITH {UNTRAINED} SELECT volume_id, z, sum(mu16 * (x + 1))::BIGINT AS mu16, sum(ls8 * (y + 1))::BIGINT AS log_scale8, count(*)::BIGINT AS n FROM pred GROUP BY volume_id, z")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all samples that no flat flag codes."""
    s = untrained(spark, sf_dir).where(~(F.col("flat") & (F.col("v") == F.col("w"))))
    return s.groupBy("volume_id", "z").agg(F.sum(F.col("mu16") * (F.col("x") + 1)).alias("mu16"), F.sum(F.col("log_scale8") * (F.col("y") + 1)).alias("log_scale8"), F.count("*").alias("n"))


@query("volume_sha", f"WITH {VOL} SELECT z, sha256(unhex(string_agg(printf('%02x%02x', v & 255, (v >> 8) & 255), '' ORDER BY y, x))) AS digest FROM vol GROUP BY z")
def volume_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every slice as 16-bit little-endian samples."""
    byte = lambda c: F.lpad(F.hex(c.bitwiseAND(F.lit(255))), 2, "0")
    raw = F.array_join(F.transform("s", lambda v: F.concat(byte(v), byte(F.shiftright(v, 8)))), "")
    listed = rows(spark, sf_dir).select("z", "y", raw.alias("raw")).groupBy("z").agg(F.array_sort(F.collect_list(F.struct("y", "raw"))).alias("p"))
    return listed.select("z", F.sha2(F.unhex(F.array_join(F.transform("p", lambda x: x["raw"]), "")), 256).alias("digest"))


@query("scan_npy", f"WITH {VOL}, f AS (SELECT *, count(*) OVER (PARTITION BY z) AS n FROM vol) SELECT 'slice' || z || CASE WHEN z % 4 = 3 THEN '.raw' ELSE '.npy' END AS path, CASE WHEN z % 4 = 3 THEN 'unknown extension' END AS reason, CASE WHEN z % 4 < 3 THEN (count(DISTINCT y))::INT END AS height, CASE WHEN z % 4 < 3 THEN sum(v * (y * 64 + x + 1))::BIGINT END AS weighted FROM f GROUP BY z")
def scan_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices written as .npy files and read back; a file of another kind is a row with its reason."""
    listed = rows(spark, sf_dir).groupBy("z").agg(F.array_sort(F.collect_list(F.struct("y", "s"))).alias("p"))
    flat = listed.select("z", F.size("p").alias("h"), F.flatten(F.transform("p", lambda x: x["s"])).alias("v"))

    def write(heights: pa.Array, values: pa.Array) -> pa.Array:
        return pa.array([arrays.write_npy(np.array(v, "<i2").reshape(1, h, -1)) for h, v in zip(heights.to_pylist(), values.to_pylist(), strict=True)], pa.binary())

    name = F.concat(F.lit("slice"), F.col("z").cast("string"), F.when(F.col("z") % 4 == 3, ".raw").otherwise(".npy"))
    files = flat.select(name.alias("path"), F.arrow_udf(write, "binary")("h", "v").alias("content"))
    weighted = F.aggregate(F.zip_with("samples", F.sequence(F.lit(1), F.size("samples")), lambda v, i: v.cast("bigint") * i), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return arrays.slices(files).select("path", "reason", "height", F.when(F.col("reason").isNull(), weighted).alias("weighted"))


@query("zstd_roundtrip", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, true AS same, true AS bounded FROM documents WHERE text IS NOT NULL")
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed and restored; a frame that claims too much is refused."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("raw"))
    framed = own.withColumn("frame", zstd_compress(F.col("raw")))
    bomb = F.concat(F.unhex(F.lit("FFFFFFFFFFFF0000")), F.substring("frame", 9, 1 << 30))
    back = framed.select("doc_id", F.octet_length("raw").cast("bigint").alias("n"), zstd_decompress(F.col("frame"))["content"].eqNullSafe(F.col("raw")).alias("same"), zstd_decompress(bomb)["error"].isNotNull().alias("bounded"))
    return back


@lru_cache
def _fixed(syntax: str) -> bytes:
    """A file of that syntax without elements."""
    return dicom.write([], syntax)


@lru_cache(1 << 10)
def _number(n: int, explicit: bool, order: str) -> bytes:
    return dicom.element(0x00200013, b"IS", str(n).encode(), explicit, order)


@lru_cache(1 << 12)
def _image(v: int, placed: bool, pixels: bool, swapped: str, explicit: bool, order: str) -> bytes:
    """The elements behind the instance number: place, layout and samples of 4 x 4 counting from v."""
    u16 = lambda x: int(x).to_bytes(2, swapped)
    els = [(0x00280010, b"US", u16(4)), (0x00280011, b"US", u16(4)), (0x00280100, b"US", u16(16)), (0x00280101, b"US", u16(12)), (0x00280102, b"US", u16(11)), (0x00280103, b"US", u16(0))]
    if placed:
        els += [(0x00200032, b"DS", f"0\\0\\{v}".encode()), (0x00200037, b"DS", b"1\\0\\0\\0\\1\\0")]
    if pixels:
        els.append((0x7FE00010, b"OW", b"".join(u16((v + i) % 4096) for i in range(16))))
    return b"".join(dicom.element(t, k, x, explicit, order) for t, k, x in sorted(els))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as synthetic files: slices, projections, encapsulated, deflated and broken ones."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))

    def write(orders: pa.Array, lines: pa.Array, parts: pa.Array, q: pa.Array) -> pa.Array:
        out = []
        for o, n, p, v in zip(orders.to_pylist(), lines.to_pylist(), parts.to_pylist(), q.to_pylist(), strict=True):
            syntax = dicom.DEFLATED if p % 13 == 5 else dicom.BIG if p % 11 == 1 else dicom.IMPLICIT if p % 11 == 2 else dicom.EXPLICIT
            explicit, order = syntax != dicom.IMPLICIT, "big" if syntax == dicom.BIG else "little"
            swapped = "big" if p % 11 == 1 else "little"
            head, sop = _fixed(syntax), dicom.element(0x00080018, b"UI", f"1.2.{p}".encode(), explicit, order)
            own = dicom.element(0x0020000E, b"UI", f"9.{o}".encode(), explicit, order), _number(n, explicit, order)
            raw = b"".join((head, sop, *own, _image(v, p % 3 > 0, p % 7 > 0, swapped, explicit, order)))
            out.append(raw[:100] if p % 17 == 3 else raw)
        return pa.array(out, pa.binary())

    content = F.arrow_udf(write, "binary")("l_orderkey", "l_linenumber", "l_partkey", "q")
    return own.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("path"), content.alias("content"))


_REASON = "CASE WHEN l_partkey % 17 = 3 THEN 'unparsable' WHEN l_partkey % 13 = 5 THEN 'deflated' WHEN l_partkey % 7 = 0 THEN 'no_pixel_data' END"


@query("classify_files", f"SELECT coalesce({_REASON}, 'coded') AS kind, count(*)::BIGINT AS n, count(*) FILTER ({_REASON} IS NULL AND l_partkey % 3 > 0)::BIGINT AS n_placed, coalesce(sum(floor(l_quantity) * 10000) FILTER ({_REASON} IS NULL AND l_partkey % 3 > 0), 0)::BIGINT AS positions FROM lineitem GROUP BY ALL")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files parsed, classified and placed along their normal."""
    parsed = dicom.parsed(_files(spark, sf_dir)).drop("signed")
    out = S.layout(*[F.col(c) for c in ("samples_per_pixel", "rows", "columns", "bits_allocated", "bits_stored", "high_bit", "pixel_representation", "frames")])
    known = parsed.withColumn("layout_error", F.when(F.col("has_pixels"), out["layout_error"])).withColumn("kind", F.coalesce(S.classify(), F.lit("coded")))
    placed = F.when(F.col("kind") == "coded", S.slice_position(F.col("orientation"), F.col("position")))
    return known.withColumn("place", placed).groupBy("kind").agg(F.count("*").alias("n"), F.count("place").alias("n_placed"), F.coalesce(F.sum("place"), F.lit(0)).alias("positions"))


@query("archive_ls", f"""WITH f AS (SELECT l_orderkey AS series, l_linenumber AS n, l_partkey AS p, {_REASON} IS NULL AS coded FROM lineitem)
SELECT '9.' || series AS series, count(*)::BIGINT AS n_instances, sum(CASE WHEN p % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS n_placed FROM f WHERE coded GROUP BY series""")
def archive_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a written archive of the files lists of its coded instances; no bytes of files are read."""
    return A.listing(_archive(spark, sf_dir)).select("series", "n_instances", "n_placed")


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    A.write(A.pack(_files(spark, sf_dir)), at)
    return A.opened(spark, at)


@query("archive_restore", f"SELECT CASE WHEN {_REASON} IS NULL THEN 'coded' ELSE 'raw' END AS kind, count(*)::BIGINT AS n, count(*)::BIGINT AS n_restored FROM lineitem GROUP BY 1")
def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files restored from a written archive, byte for byte by their digests."""
    back = A.restore(_archive(spark, sf_dir))
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_restored"))


@query("compact_verify", "SELECT source, count(*)::BIGINT AS n_objects, sum(octet_length(encode(text)))::BIGINT AS bytes_in, true AS verified FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")
def compact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a series framed and restored, byte for byte, before anything is switched; one that doesn't come back leaves its series unverified."""
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("source", F.col("text").cast("binary").alias("raw"))
    framed = own.select("source", F.sha2("raw", 256).alias("sha"), F.octet_length("raw").alias("n"), zstd_compress(F.col("raw"), 6).alias("frame"))
    restored = framed.withColumn("ok", F.sha2(zstd_decompress(F.col("frame"))["content"], 256).eqNullSafe(F.col("sha")))
    return restored.groupBy("source").agg(F.count("*").alias("n_objects"), F.sum("n").alias("bytes_in"), F.every("ok").alias("verified"))
