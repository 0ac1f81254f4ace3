"""Archives, the compactor's switch, uploads, layered settings and bootstrap intervals."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import settings
from stratavox.functions.digests import zstd_compress, zstd_decompress
from stratavox.operators import archive, evaluation, index
from stratavox.plans import files as plans
from stratavox.plans import registry
from stratavox.sources import catalogue, dicom
from stratavox.streaming import compaction


def _file(series, number, place, pixels=bytes(range(32)), syntax=dicom.EXPLICIT, tail=b""):
    u16 = lambda x: x.to_bytes(2, "little")
    els = [(0x0020000E, b"UI", series), (0x00200013, b"IS", str(number).encode()), (0x00280010, b"US", u16(4)), (0x00280011, b"US", u16(4)), (0x00280100, b"US", u16(16)), (0x00200032, b"DS", f"0\\0\\{place}".encode()), (0x00200037, b"DS", b"1\\0\\0\\0\\1\\0"), (0x7FE00010, b"OW", pixels)]
    return dicom.write(els, syntax) + tail


def _archive(spark, files, folder):
    archive.write(archive.pack(spark.createDataFrame(files, "path string, content binary")), folder)
    return archive.opened(spark, folder)


def test_archive_restores_every_kind(spark, tmp_path):
    files = {
        "b": _file(b"1.2", 2, 5), "a": _file(b"1.2", 1, 9), "odd": _file(b"1.2", 3, 1, bytes(30)), "deflated": _file(b"1.2", 4, 1, syntax=dicom.DEFLATED),
        "junk": b"no such file", "empty": b"", "behind": _file(b"1.2", 5, 2, tail=dicom.element(0xFFFCFFFC, b"OB", b"tail")),
    }
    own = _archive(spark, [*files.items(), ("none", None)], str(tmp_path / "a"))
    back = {r.path: r for r in archive.restore(own).collect()}
    assert all(bytes(back[p].content) == raw and back[p].ok for p, raw in files.items())
    assert bytes(back["none"].content) == b""
    assert {p for p, r in back.items() if r.kind == "coded"} == {"a", "b", "behind"}
    assert [tuple(r) for r in archive.listing(own).select("series", "n_instances", "n_placed").collect()] == [("1.2", 3, 3)]
    assert [r.path for r in own.where("kind = 'coded'").orderBy("place").collect()] == ["behind", "b", "a"]


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT, dicom.BIG])
def test_elements_that_were_seen_are_followed_alike(monkeypatch, syntax):
    def told(raw):
        try:
            return dicom.parse(raw)
        except ValueError as e:
            return str(e)

    whole = _file(b"1.2", 7, 3, syntax=syntax) + dicom.element(0xFFFCFFFC, b"OB", b"tail", syntax != dicom.IMPLICIT, "big" if syntax == dicom.BIG else "little")
    cuts = [whole[:n] for n in range(len(whole) + 1)] + [whole[:n] + b"\xff" + whole[n + 1 :] for n in range(132, len(whole))]
    monkeypatch.setattr(dicom, "_MOST_SEEN", 0)
    monkeypatch.setattr(dicom, "_SEEN", {k: {} for k in dicom._SEEN})
    first = [told(raw) for raw in cuts]
    assert not any(dicom._SEEN.values())
    monkeypatch.setattr(dicom, "_MOST_SEEN", 8)
    assert [[told(raw) for raw in cuts] for _ in range(2)] == [first] * 2
    assert max(map(len, dicom._SEEN.values())) == 8


def test_damaged_members_are_told(spark, tmp_path):
    own = _archive(spark, [("a", _file(b"1.2", 1, 9)), ("b", _file(b"1.2", 2, 5))], str(tmp_path / "a"))
    bad = own.drop("invalid").withColumn("tail", F.lit(None).cast("binary")).withColumn("n_bytes", F.when(F.col("path") == "a", F.lit(-1)).otherwise(F.col("n_bytes")))
    bad.write.parquet(str(tmp_path / "bad"))
    got = archive.opened(spark, str(tmp_path / "bad"))
    assert {r.path: r.invalid for r in got.collect()} == {"a": "no size", "b": None}
    assert [(r.ok, r.content) for r in archive.restore(got).collect()] == [(False, None)] * 2


def test_listing_reads_no_frames(spark, tmp_path, capsys):
    own = _archive(spark, [("a", _file(b"1.2", 1, 9))], str(tmp_path / "a"))
    archive.listing(own).explain("formatted")
    plan = capsys.readouterr().out
    assert "head:" not in plan and "pixels:" not in plan


def test_empty_archive(spark, tmp_path):
    assert archive.restore(_archive(spark, [], str(tmp_path / "a"))).count() == 0


def _parts(folder):
    return [p for p in folder.rglob("*.parquet") if p.is_file()]


@pytest.mark.parametrize("name", ["archive_ls", "archive_restore"])
def test_an_archive_is_all_that_packing_leaves(spark, data, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(_parts(shared))
    registry.queries()[name](spark, data).collect()
    left = set(_parts(shared)) - before
    assert {p.parent.name.split("-")[0] for p in left} == {"archive"}
    assert sum(p.stat().st_size for p in left) < 100 * spark.read.parquet(f"{data}/lineitem.parquet").count()


def test_one_large_series_spreads(spark, tmp_path):
    files = spark.createDataFrame([(f"{i:04}", _file(b"1.2", i, i * 7 % 3000)) for i in range(3000)], "path string, content binary").repartition(4)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        archive.write(archive.pack(files), str(tmp_path / "a"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = [[r.place for r in spark.read.parquet(str(p)).select("place").collect()] for p in _parts(tmp_path / "a")]
    assert len(parts) > 2 and max(map(len, parts)) < 2000
    assert all(p == sorted(p) for p in parts)
    back = archive.restore(archive.opened(spark, str(tmp_path / "a")))
    assert back.where("ok").select("path").distinct().count() == 3000


def test_pixels_that_lost_a_byte_are_told(spark, tmp_path):
    own = _archive(spark, [("a", _file(b"1.2", 1, 9))], str(tmp_path / "a"))
    assert [(r.ok, r.content) for r in archive.restore(own.withColumn("pixels", F.substring("pixels", 1, 31))).collect()] == [(False, None)]


def test_compaction_moves_what_is_current(spark, tmp_path):
    raw = spark.createDataFrame([("b", "k1", 1, 7, b"one" * 99), ("b", "k2", 2, 7, b"two" * 99), ("b", "k3", 3, 7, b"x"), ("b", "k4", 4, 8, b"other")], "bucket string, key string, seq bigint, series bigint, content binary")
    state = spark.createDataFrame([("b", "k1", 1, False), ("b", "k2", 9, False), ("b", "k3", 3, True), ("b", "k4", 4, False)], "bucket string, key string, seq bigint, deleted boolean")
    due = spark.createDataFrame([(7,), (7,)], "series bigint")
    for _ in range(2):  # a batch that is run again gives the same
        compaction.compact(due, raw, lambda: state, str(tmp_path), 5)
    moves = spark.read.parquet(str(tmp_path / "moves"))
    assert [(r.key, r.seq, r.archive) for r in moves.collect()] == [("k1", 1, 5)]
    assert spark.read.parquet(str(tmp_path / "archives")).count() == 3
    now = {r.key: r.archive for r in compaction.switched(state, moves).collect()}
    assert now == {"k1": 5, "k2": None, "k3": None, "k4": None}
    row = compaction.accounting(moves).first()
    assert (row.n_objects, row.bytes_in) == (1, 297) and row.bytes_out < 297 and 0 < row.saving < 1


def _events(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=h), u, "put", 1.0, "") for i, h, u in ((1, 0, 7), (2, 1, 7), (3, 0, 8), (4, 99, 9))]
    spark.createDataFrame(rows, compaction.EVENTS).coalesce(1).write.parquet(folder)


def _damaged(c, level=3):
    """Frames of which some lack their end."""
    frame = zstd_compress(c, level)
    return F.when(F.crc32(c) % 3 == 0, F.substring(frame, 1, 12)).otherwise(frame)


def test_objects_that_fail_are_not_verified(spark, data, monkeypatch):
    monkeypatch.setattr(plans, "zstd_compress", _damaged)
    rows = registry.queries()["compact_verify"](spark, data).collect()
    failing = {r.source for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL AND crc32(cast(text AS binary)) % 3 = 0").select("source").distinct().collect()}
    assert failing & {r.source for r in rows}
    assert all(r.verified is (r.source not in failing) for r in rows)


def test_frames_that_fail_say_why(spark):
    frame = (5).to_bytes(8, "little") + b"junk"
    bomb, short = (1 << 60).to_bytes(8, "little") + b"junk", b"\1\2"
    rows = spark.createDataFrame([(0, None), (1, frame), (2, bomb), (3, short)], "i int, f binary").unionAll(spark.range(2).select((F.col("id") + 4).cast("int"), zstd_compress(F.when(F.col("id") == 0, b"").otherwise(b"abc"))))
    got = {r.i: r.r for r in rows.select("i", zstd_decompress(F.col("f")).alias("r")).collect()}
    assert tuple(got[0]) == (None, None)
    assert all(got[i].content is None and got[i].error for i in (1, 2, 3)) and "hold" in got[2].error
    assert [(bytes(got[i].content), got[i].error) for i in (4, 5)] == [(b"", None), (b"abc", None)]


def test_compactor_stream(spark, tmp_path):
    _events(spark, str(tmp_path / "in"))
    raw = spark.createDataFrame([("put", "u7/1", 1, 7, b"a"), ("put", "u7/2", 2, 7, b"b"), ("put", "u8/3", 3, 8, b"c"), ("put", "u9/4", 4, 9, b"d")], "bucket string, key string, seq bigint, series bigint, content binary")
    state = raw.select("bucket", "key", "seq", F.lit(False).alias("deleted"))
    sessions = compaction.quiet_series(compaction.puts(spark, str(tmp_path / "in")), least=2)
    compaction.run_compactor(sessions, lambda: raw, lambda: state, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out/moves")).collect()) == ["u7/1", "u7/2"]


def test_gauges_and_last_puts_follow_the_stream(spark, tmp_path):
    _events(spark, str(tmp_path / "in"))
    stream = compaction.puts(spark, str(tmp_path / "in"))
    log = lambda: index.object_log(spark.read.parquet(str(tmp_path / "in")))
    compaction.refresh_gauges(stream, log, str(tmp_path / "gauges"), str(tmp_path / "s1")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "gauges")).first()
    assert (row.raw, row.archived) == (3, 1)
    compaction.last_puts(stream).writeStream.outputMode("complete").format("memory").queryName("last_puts").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()
    assert {r.series: (r.last_put.hour, r.n_puts) for r in spark.table("last_puts").collect()}[7] == (1, 2)


def test_uploads_end_with_their_parts(spark):
    e = [("a", 0, "create", None), ("a", 1, "part", 1), ("a", 2, "part", 1), ("a", 3, "part", 2), ("b", 0, "create", None), ("b", 1, "part", 1), ("b", 2, "abort", None), ("c", 1, "part", 1), ("d", 5, "create", None), ("d", 4, "part", 1)]
    log = spark.createDataFrame([(*r, f"e{r[1]}", 10) for r in e], "upload string, seq bigint, kind string, number bigint, etag string, size bigint")
    assert sorted((r.upload, r.number, r.etag) for r in index.upload_parts(log).collect()) == [("a", 1, "e2"), ("a", 2, "e3")]


def test_listing_pages_meet(spark):
    keys = spark.createDataFrame([(k,) for k in ("p/a", "p/b/1", "p/b/2", "p/b0", "p/c/1", "q")], "key string")
    seen, after = [], ""
    while page := index.listing(keys, "p/", "/", after, 2).collect():
        seen += [(r.entry, r.is_prefix, r.n_keys) for r in page]
        after = page[-1].entry
    assert seen == [("p/a", False, 1), ("p/b/", True, 2), ("p/b0", False, 1), ("p/c/", True, 1)]


def test_replicates_agree_with_the_normal_interval(spark):
    x = np.random.default_rng(3).normal(5, 2, 4000)
    rows = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)] + [(9999, "g", None)], "id bigint, group string, value double").repartition(3)
    means = np.array([r["mean"] for r in evaluation.replicate_means(rows).collect()])
    half = 1.96 * x.std() / len(x) ** 0.5
    low, high = np.percentile(means, [2.5, 97.5])
    assert len(means) == 10_000
    assert low == pytest.approx(x.mean() - half, abs=0.08 * half) and high == pytest.approx(x.mean() + half, abs=0.08 * half)


def test_damaged_results_are_kept(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,codec,modality,bytes,raw,encode_s,decode_s,lossless\n1,own,CT,5,10,1.5,2,true\n2,own,CT,many,10,1,2,true\n")
    assert [(r.id, r.bytes, r.bad is not None) for r in catalogue.results(spark, str(tmp_path / "r.csv")).orderBy("id").collect()] == [("1", 5, False), ("2", None, True)]


def test_layers_of_settings(spark):
    base = {"quiet_seconds": 30, "folder": "a", "verify": True}
    assert settings.load(base, 'folder = "b"\nquiet_seconds = 5', {"STRATAVOX_QUIET_SECONDS": "7", "STRATAVOX_VERIFY": "false"}) == {"quiet_seconds": 7, "folder": "b", "verify": False}
    for toml, env in (("other = 1", {}), ('quiet_seconds = "5"', {}), ("", {"STRATAVOX_VERIFY": "maybe"})):
        with pytest.raises(ValueError):
            settings.load(base, toml, env)
    assert settings.credentials("a:b:c, d:e") == {"a": "b:c", "d": "e"}
    with pytest.raises(ValueError):
        settings.credentials("a:")
