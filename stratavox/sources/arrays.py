"""Array files: .npy and NIfTI-1, read from a binaryFile scan and written back.

Errors are data: a file that can't be read gives a row with its reason.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = "path string, reason string, bits int, signed boolean, depth int, height int, width int, z int, samples array<int>"
#: Sample types of NIfTI-1 files by their code (fixed values).
NIFTI_TYPES = {2: "u1", 256: "i1", 4: "i2", 512: "u2"}


def read_npy(raw: bytes) -> np.ndarray:
    """(depth, height, width) of a 2-D or 3-D array of 8- or 16-bit integers in C order."""
    stream = io.BytesIO(raw)
    t = np.lib.format.read_array(stream, allow_pickle=False)
    if t.ndim not in (2, 3) or not t.size:
        raise ValueError(f"shape {t.shape}")
    if t.flags.f_contiguous and not t.flags.c_contiguous:
        raise ValueError("Fortran order")
    if t.dtype.kind not in "iu" or t.dtype.itemsize > 2:
        raise ValueError(f"samples of type {t.dtype}")
    if stream.tell() != len(raw):
        raise ValueError(f"{len(raw) - stream.tell()} bytes behind the samples")
    return t.reshape((1,) * (3 - t.ndim) + t.shape)


def write_npy(t: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(t[0] if len(t) == 1 else t), version=(1, 0))
    return out.getvalue()


def read_nifti(raw: bytes) -> tuple[np.ndarray, bytes]:
    """Samples and header (up to the samples) of a single-file NIfTI-1 volume, plain or gzipped."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < 352:
        raise ValueError("shorter than a header")
    order = "<" if int.from_bytes(raw[:4], "little") == 348 else ">" if int.from_bytes(raw[:4], "big") == 348 else ""
    if not order or raw[344:348] != b"n+1\0":
        raise ValueError("not a single-file NIfTI-1 volume")
    dims = np.frombuffer(raw[40:56], f"{order}i2").astype(int)
    code = int(np.frombuffer(raw[70:72], f"{order}i2")[0])
    start = int(np.frombuffer(raw[108:112], f"{order}f4")[0])
    if not 2 <= dims[0] <= 4 or (dims[1 : dims[0] + 1] < 1).any():
        raise ValueError(f"dimensions {dims.tolist()}")
    if code not in NIFTI_TYPES:
        raise ValueError(f"data type {code}")
    width, height, *rest = dims[1 : dims[0] + 1].tolist()
    depth = int(np.prod(rest)) if rest else 1
    kind = np.dtype(f"{order}{NIFTI_TYPES[code]}")
    n = depth * height * width * kind.itemsize
    if start < 352 or len(raw) != start + n:
        raise ValueError(f"{len(raw) - start} bytes of samples, not {n}")
    return np.frombuffer(raw[start:], kind).reshape(depth, height, width), raw[:start]


def restore_nifti(header: bytes, t: np.ndarray) -> bytes:
    """The file that read_nifti() was given, unless it was gzipped."""
    order = "<" if int.from_bytes(header[:4], "little") == 348 else ">"
    code = int(np.frombuffer(header[70:72], f"{order}i2")[0])
    return header + t.astype(f"{order}{NIFTI_TYPES[code]}").tobytes()


def read_volume(path: str, raw: bytes) -> np.ndarray:
    name = path.lower()
    if name.endswith(".npy"):
        return read_npy(raw)
    if name.endswith((".nii", ".nii.gz")):
        return read_nifti(raw)[0]
    raise ValueError("unknown extension")


def slices(files: DataFrame) -> DataFrame:
    """One row per slice of every file in (path, content), or one with the reason why it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    t = read_volume(path, bytes(content))
                except (ValueError, EOFError, OSError) as e:
                    yield pd.DataFrame([{"path": path, "reason": str(e), "bits": None, "signed": None, "depth": None, "height": None, "width": None, "z": None, "samples": None}])
                    continue
                d, h, w = t.shape
                yield pd.DataFrame({"path": path, "reason": None, "bits": 8 * t.dtype.itemsize, "signed": t.dtype.kind == "i", "depth": d, "height": h, "width": w, "z": range(d), "samples": list(t.reshape(d, -1).astype(np.int32))})

    return files.select("path", "content").mapInPandas(run, SLICES)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of all files below a folder; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":")[-1].lstrip("/")
    return slices(files.withColumn("path", F.regexp_replace("path", f"^.*{root}/", "")))


def described(spark: SparkSession, folder: str, split: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Slices of the volumes of a folder of <id>.json and <id>.npy files, with the fields of their descriptions.

    Descriptions are filtered before a volume is opened: only files whose id is left are read.
    """
    about = spark.read.option("multiLine", "true").json(f"{folder}/*.json")
    if split:
        about = about.where(F.col("split") == split)
    if exclude:
        about = about.where(~F.col("id").isin(*exclude))
    files = spark.read.format("binaryFile").load(f"{folder}/*.npy")
    named = files.withColumn("id", F.regexp_extract("path", r"([^/]*)\.npy$", 1)).join(about.select("id"), "id", "left_semi")
    return slices(named).withColumn("id", F.regexp_extract("path", r"([^/]*)\.npy$", 1)).join(about, "id")
