"""Checksums and frames that Spark has no function for, as Arrow functions of whole columns."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: CRC-32C (Castagnoli), reflected.
_POLY = 0x82F63B78


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_TABLE = _byte_table()


def _zeros(crc: np.ndarray, n: int) -> np.ndarray:
    """Checksum registers after n zero bytes: the register is linear, so powers of the one-byte step are squared."""
    step = np.array([_TABLE[(1 << i) & 0xFF] ^ ((1 << i) >> 8) for i in range(32)], np.uint32)
    apply = lambda m, x: np.bitwise_xor.reduce(np.where((x[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m[None, :], 0), axis=1).astype(np.uint32)
    while n:
        if n & 1:
            crc = apply(step, crc)
        step, n = apply(step, step), n >> 1
    return crc


def crc32c(data: bytes) -> int:
    """CRC-32C: equal pieces are run side by side in numpy and joined through the register's linearity."""
    raw = np.frombuffer(data, np.uint8)
    lanes = max(1, int(len(raw) ** 0.5) // 2)
    size = len(raw) // lanes
    crc = np.zeros(lanes, np.uint32)
    crc[0] = 0xFFFFFFFF
    body = raw[: lanes * size].reshape(lanes, size)
    for k in range(size):
        crc = _TABLE[(crc ^ body[:, k]) & 0xFF] ^ (crc >> np.uint32(8))
    total = crc[:1]
    for c in crc[1:]:
        total = _zeros(total, size) ^ c
    value = int(total[0])
    for b in raw[lanes * size :].tolist():
        value = int(_TABLE[(value ^ b) & 0xFF]) ^ (value >> 8)
    return value ^ 0xFFFFFFFF


def crc32c_column(c: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([None if x is None else crc32c(x) for x in a.to_pylist()], pa.int64()), "bigint")(c.cast("binary"))


def hmac_sha256(key: Column, message: Column) -> Column:
    def run(keys: pa.Array, messages: pa.Array) -> pa.Array:
        return pa.array([None if k is None or m is None else hmac.new(k, m, hashlib.sha256).digest() for k, m in zip(keys.to_pylist(), messages.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(key.cast("binary"), message.cast("binary"))


def zstd_compress(c: Column, level: int = 3) -> Column:
    def run(a: pa.Array) -> pa.Array:
        codec = pa.Codec("zstd", compression_level=level)
        return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in a.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(c.cast("binary"))


def zstd_decompress(c: Column, most_ratio: int = 1 << 16) -> Column:
    """(content, error) of frames of zstd_compress(): one of the two is null, both where there is no frame.

    error tells why a frame doesn't decode, or that it claims to expand beyond the
    bound. Want of memory is no fault of a frame: it is raised.
    """

    def one(x: bytes | None) -> tuple[bytes | None, str | None]:
        if x is None:
            return None, None
        if len(x) < 8:
            return None, "no size"
        if (size := int.from_bytes(x[:8], "little")) > most_ratio * len(x):
            return None, "more than a frame can hold"
        try:
            return pa.decompress(x[8:], decompressed_size=size, codec="zstd", asbytes=True), None
        except (OSError, pa.ArrowInvalid) as e:
            return None, str(e) or "does not decode"

    def run(a: pa.Array) -> pa.Array:
        content, error = zip(*map(one, a.to_pylist()), strict=True) if len(a) else ((), ())
        return pa.StructArray.from_arrays([pa.array(content, pa.binary()), pa.array(error, pa.string())], ["content", "error"])

    return F.arrow_udf(run, "struct<content: binary, error: string>")(c)
