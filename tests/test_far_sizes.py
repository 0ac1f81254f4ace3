"""What only larger tables show: far dates, ragged last slices, many batches and partitions."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import rows_of, sql_rows
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from stratavox.operators import archive, codec, evaluation
from stratavox.plans import files as plans
from stratavox.plans import registry
from stratavox.sources import dicom


def with_table(tmp_path, name, sql):
    """A folder that holds one table, made by DuckDB, and a connection that sees it."""
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), con


def same(spark, folder, con, name):
    names, want = sql_rows(con, registry.oracle_sql()[name])
    df = registry.queries()[name](spark, folder)
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_iso8601_of_years_beyond_9999(spark, tmp_path):
    folder, con = with_table(tmp_path, "events", "SELECT i * 6000 AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts FROM range(1000) t(i)")
    same(spark, folder, con, "iso8601")


@pytest.mark.parametrize("name", ["decode_roundtrip", "decode_slices", "inspect"])
@pytest.mark.parametrize("rows", ["range(206)", "range(230) t WHERE range % 7 <> 3 AND range NOT BETWEEN 60 AND 130"])
def test_tiles_with_rows_missing(spark, tmp_path, name, rows):
    folder, con = with_table(tmp_path, "embeddings", f"SELECT range AS vec_id, list_transform(range(64), lambda i: ((range * 37 + i * i) % 997 / 500.0)::FLOAT) AS embedding FROM {rows}")
    same(spark, folder, con, name)


def test_tiles_with_a_row_twice_are_refused(spark):
    rows = spark.createDataFrame([("v", 0, 1, [1, 2]), ("v", 0, 2, [3, 4]), ("v", 0, 2, [5, 6])], "volume_id string, z int, y int, s array<int>")
    with pytest.raises(PythonException, match="row 2 of slice 0 is there twice"):
        codec.encode(rows, 2, 4).collect()


def test_counts_are_those_of_the_whole_draw():
    ids, reps, seed = np.arange(300) * 7919 + 5, 700, 3
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(reps, dtype=np.uint64) + np.uint64(seed << 32))[None, :] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    want = np.searchsorted(evaluation._POISSON, u, side="right")
    assert (evaluation._counts(ids, reps, seed) == want).all()
    assert (evaluation._counts(ids, np.arange(100, 200, dtype=np.uint64), seed) == want[:, 100:200]).all()
    assert evaluation._BY_TOP[-1] == evaluation._UNSURE > 18


@pytest.mark.parametrize("name", ["far_context", "compact_verify"])
def test_batches_of_workers_are_bounded(spark, data, name):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    registry.queries()[name](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 4096
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_files_are_made_and_parsed_once_for_an_archive(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def content(paths: pa.Array) -> pa.Array:
        seen.add(len(paths))
        return pa.array([dicom.write([(0x0020000E, b"UI", f"9.{p}".encode())]) for p in paths.to_pylist()], pa.binary())

    files = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("path")).withColumn("content", F.arrow_udf(content, "binary")("path"))
    archive.write(archive.pack(files), str(tmp_path / "a"))
    assert seen.value == 40
    assert archive.restore(archive.opened(spark, str(tmp_path / "a"))).where("ok").count() == 40


def test_synthetic_files_are_those_of_their_elements(spark, tmp_path):
    folder, _ = with_table(tmp_path, "lineitem", "SELECT i AS l_orderkey, (i % 7)::INT AS l_linenumber, i * 5 + 1 AS l_partkey, (i % 50)::DOUBLE AS l_quantity FROM range(700) t(i)")
    for r in plans._files(spark, folder).collect():
        order, (line, p) = int(r.path.split("/")[0]), map(int, r.path.split("/")[1].split("-"))
        u16 = lambda x: int(x).to_bytes(2, "big" if p % 11 == 1 else "little")  # noqa: B023,E731
        els = [(0x00080018, b"UI", f"1.2.{p}".encode()), (0x0020000E, b"UI", f"9.{order}".encode()), (0x00200013, b"IS", str(line).encode()), *[(t, b"US", u16(n)) for t, n in ((0x00280010, 4), (0x00280011, 4), (0x00280100, 16), (0x00280101, 12), (0x00280102, 11), (0x00280103, 0))]]
        els += [(0x00200032, b"DS", f"0\\0\\{order % 50}".encode()), (0x00200037, b"DS", b"1\\0\\0\\0\\1\\0")] if p % 3 else []
        els += [(0x7FE00010, b"OW", b"".join(u16(order % 50 + i) for i in range(16)))] if p % 7 else []
        raw = dicom.write(els, dicom.DEFLATED if p % 13 == 5 else dicom.BIG if p % 11 == 1 else dicom.IMPLICIT if p % 11 == 2 else dicom.EXPLICIT)
        assert bytes(r.content) == (raw[:100] if p % 17 == 3 else raw)
