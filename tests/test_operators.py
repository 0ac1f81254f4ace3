"""Operators against plain Python, round trips and edge cases."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import digests as D
from stratavox.functions import integers as I
from stratavox.functions import text as T
from stratavox.operators import codec, index, network
from stratavox.operators import context as C
from stratavox.operators import volumes as V
from stratavox.sources import arrays, dicom


def volume(depth, height, width, top=4095, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, top + 1, (depth, height, width)) // 7 + np.arange(width) * 3
    t[:, :, width // 2 :] = 40
    return np.where(rng.random(t.shape) < 0.1, rng.integers(0, top + 1, t.shape), t).clip(0, top)


def as_rows(spark, t, volume_id="v"):
    return spark.createDataFrame([(volume_id, int(z), int(y), [int(v) for v in t[z, y]]) for z in range(t.shape[0]) for y in range(t.shape[1])], "volume_id string, z int, y int, s array<int>")


def padded_plane(t, y, t0):
    """A causal plane seen from row y, written out sample by sample."""
    h, w = t.shape

    def at(r, x):
        if r < 0:
            return t0
        if x < 0:
            return t0 if r == 0 else int(t[r - 1, 0])
        return int(t[r, min(x, w - 1)])

    return at


@pytest.mark.parametrize("shape,slab,stripe", [((5, 7, 9), 2, 3), ((1, 4, 3), 4, 16), ((3, 1, 6), 8, 8)])
def test_context_matches_a_padded_plane(spark, shape, slab, stripe):
    t = volume(*shape)
    got = {(r["z"], r["y"], r["x"]): r for r in C.sample_context(as_rows(spark, t), slab, stripe).collect()}
    assert len(got) == t.size
    for (z, y, x), r in got.items():
        z0, y0 = z // slab * slab, y // stripe * stripe
        tile = t[z0 : z0 + slab, y0 : y0 + stripe]
        t0, dz, dy = int(tile[0, 0, 0]), z - z0, y - y0
        at = padded_plane(tile[dz], dy, t0)
        assert (r["n"], r["nn"], r["nw"], r["ne"]) == (at(dy - 1, x), at(dy - 2, x), at(dy - 1, x - 1), at(dy - 1, x + 1))
        assert (r["w"], r["ww"], r["www"]) == (at(dy, x - 1), at(dy, x - 2), at(dy, x - 3))
        if dz:
            p, pn = int(tile[dz - 1, dy, x]), int(tile[dz - 1, max(dy - 1, 0), x])
            assert r["r"] == sorted((r["n"], p, r["n"] + p - pn))[1]
        else:
            assert r["r"] == r["n"] and r["p0"] is None


def test_both_forms_of_far_context_agree(spark):
    for shape in ((4, 6, 5), (1, 3, 2)):
        rows = as_rows(spark, volume(*shape))
        a, b = (sorted(f(rows, 3, 4).collect(), key=lambda r: (r["z"], r["y"])) for f in (C.far_context, C.network_inputs))
        assert [(r["three_d"], r["far"]) for r in a] == [(r["three_d"], r["far"]) for r in b]


def test_contexts_stay_in_their_volume(spark):
    a, b = as_rows(spark, volume(3, 5, 6, seed=2), "a"), as_rows(spark, volume(4, 7, 9, seed=3), "b")
    for f in (C.sample_context, C.far_context, C.network_inputs):
        whole = sorted(map(str, f(a.union(b), 2, 3).collect()))
        assert whole == sorted(map(str, f(a, 2, 3).collect() + f(b, 2, 3).collect()))


def test_far_context_has_all_lanes(spark):
    t = volume(3, 6, 5)
    rows = C.far_context(as_rows(spark, t), 3, 6).collect()
    assert {len(x) for r in rows if r["three_d"] for x in r["far"]} == {30}
    assert {len(x) for r in rows if not r["three_d"] for x in r["far"]} == {12}
    one = next(r for r in rows if r["z"] == 2 and r["y"] == 3)
    p1 = np.pad(t[1], 3, mode="edge")
    r_, n, p, pn = None, int(t[2, 2, 1]), int(t[1, 3, 1]), int(t[1, 2, 1])
    r_ = sorted((n, p, n + p - pn))[1]
    act = abs(n - int(t[2, 2, 0])) + abs(n - int(t[2, 2, 2])) + abs(int(t[2, 1, 1]) - n) + abs(p - pn) + abs(n - pn)
    inv = 4194304 // (max(4 * act // 5, 2) + 2)
    for k, (dy, dx) in enumerate(C.BEFORE):
        d = int(p1[3 + 3 + dy, 1 + 3 + dx]) - r_
        m = abs(d) * inv >> 16
        q = min(m, 32 + ((m - 32) >> 2), 64 + ((m - 160) >> 5), 127)
        assert one["far"][1][11 + k] == (-q if d < 0 else q)


def test_tokens_round_trip(spark):
    rows = [(m, p, k) for m in (0, 1, 5, 13, 14, 29, 30, 31, 100, 5000, 65535) for p in (0, 7, 65535) for k in (0, 3, 14)]
    df = spark.createDataFrame(rows, "m long, p long, k long")
    t = I.tokenise(F.col("m"), F.col("p"), F.col("k"))
    back = df.select("m", I.detokenise(F.col("p"), F.col("k"), t).alias("b"), t["token"].alias("token"))
    assert all(r["m"] == r["b"] and 0 <= r["token"] <= 15 for r in back.collect())


def test_codec_round_trip(spark):
    for shape in ((5, 9, 11), (1, 1, 1), (2, 3, 4)):
        t = volume(*shape) - 900
        tiles = codec.encode(as_rows(spark, t).withColumn("volume_id", F.lit("v")), 2, 4)
        got = codec.decode(tiles).collect()
        assert all(r["ok"] for r in got) and len(got) == shape[0] * shape[1]
        assert all((np.array(r["s"]) == t[r["z"], r["y"]]).all() for r in got)


def test_codec_reports_damage(spark):
    tiles = codec.encode(as_rows(spark, volume(2, 4, 5)).withColumn("volume_id", F.lit("v")), 2, 4)
    hurt = tiles.withColumn("stream_crc", F.col("stream_crc") + 1)
    assert {r["ok"] for r in codec.decode(hurt).collect()} == {False}


def test_packing_needs_a_sparse_range(spark):
    s = spark.createDataFrame([(v * 8 - 1000,) for v in range(100)], "v int").withColumn("id", F.lit(1))
    r = V.value_stats(s, "id").first()
    assert r["packed"] and r["max_mapped"] == 99 and r["lo"] == -1000
    dense = spark.range(5000).select((F.col("id") - 2048).cast("int").alias("v"), F.lit(1).alias("id"))
    assert not V.value_stats(dense, "id").first()["packed"]


def test_crc32c():
    assert D.crc32c(b"123456789") == 0xE3069283
    assert D.crc32c(b"") == 0
    assert D.crc32c(bytes(32)) == 0x8A9136AA
    data = bytes(i * 7 % 256 for i in range(5000))
    value = 0xFFFFFFFF
    for b in data:
        value = int(D._TABLE[(value ^ b) & 0xFF]) ^ (value >> 8)
    assert D.crc32c(data) == value ^ 0xFFFFFFFF


def test_hmac_and_crc_columns(spark):
    df = spark.createDataFrame([(b"key", b"The quick brown fox jumps over the lazy dog"), (None, b"x")], "k binary, m binary")
    r = df.select(F.hex(D.hmac_sha256(F.col("k"), F.col("m"))), D.crc32c_column(F.col("m"))).collect()
    assert r[0][0].lower() == "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"
    assert r[0][1] == D.crc32c(b"The quick brown fox jumps over the lazy dog") and r[1][0] is None


def test_network_forms_agree(spark):
    layer = network.formula_layer(8, 5, True)
    df = spark.createDataFrame([([i * k % 255 - 127 for k in range(8)],) for i in range(20)], "x array<int>")
    r = df.select(network.forward_column(F.col("x"), [layer]).alias("a"), network.dense(F.col("x"), layer).alias("b")).collect()
    assert all(x["a"] == x["b"] for x in r)
    with pytest.raises(ValueError):
        network.validate([network.Layer(np.full((1, 70000), -128, np.int8), np.zeros(1, np.int64), 0, True)])


def test_npy_files(tmp_path, spark):
    t = volume(3, 4, 5)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.npy").write_bytes(arrays.write_npy(t.astype("<i2")))
    (tmp_path / "b.npy").write_bytes(arrays.write_npy(t[:1].astype(">u2")))
    (tmp_path / "c.npy").write_bytes(b"no array")
    np.save(tmp_path / "d.npy", np.asfortranarray(t.astype("<i2")))
    np.save(tmp_path / "e.npy", t.astype("<f4"))
    got = arrays.scan(spark, str(tmp_path)).collect()
    ok = [r for r in got if r["reason"] is None]
    assert sorted((r["path"], r["z"]) for r in ok) == [("b.npy", 0), ("sub/a.npy", 0), ("sub/a.npy", 1), ("sub/a.npy", 2)]
    assert all(r["samples"] == t[r["z"]].ravel().tolist() for r in ok)
    assert sorted(r["path"] for r in got if r["reason"]) == ["c.npy", "d.npy", "e.npy"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_nifti(order):
    t = volume(2, 3, 4).astype(f"{order}i2")
    head = bytearray(352)
    head[0:4] = struct.pack(f"{order}i", 348)
    head[40:56] = struct.pack(f"{order}8h", 3, 4, 3, 2, 1, 1, 1, 1)
    head[70:72], head[108:112], head[344:348] = struct.pack(f"{order}h", 4), struct.pack(f"{order}f", 352.0), b"n+1\0"
    raw = bytes(head) + t.tobytes()
    got, header = arrays.read_nifti(raw)
    assert (got == t).all() and arrays.restore_nifti(header, got) == raw
    assert (arrays.read_nifti(gzip.compress(raw))[0] == t).all()
    with pytest.raises(ValueError):
        arrays.read_nifti(raw + b"x")


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT, dicom.BIG])
def test_dicom(syntax):
    order = "big" if syntax == dicom.BIG else "little"
    n = lambda v: v.to_bytes(2, order)
    els = [(0x00080018, b"UI", b"1.2.3"), (0x00280010, b"US", n(3)), (0x00280011, b"US", n(4)), (0x00200032, b"DS", b"0\\1.5\\-2"), (0x7FE00010, b"OW", bytes(24))]
    raw = dicom.write(els, syntax)
    got = dicom.parse(raw)
    assert (got["rows"], got["columns"], got["sop_uid"], got["position"]) == (3, 4, "1.2.3", [0.0, 1.5, -2.0])
    assert raw[got["value_start"] : got["value_end"]] == bytes(24)
    for cut in (10, 140, len(raw) - 5):
        with pytest.raises(ValueError):
            dicom.parse(raw[:cut])


def test_dicom_sequences():
    inner = dicom.element(0x00080018, b"UI", b"9.9")
    item = b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + inner + b"\xfe\xff\x0d\xe0\0\0\0\0"
    seq = b"\x08\x00\x40\x11SQ\0\0\xff\xff\xff\xff" + item + b"\xfe\xff\xdd\xe0\0\0\0\0"
    raw = dicom.write([]) + seq + dicom.element(0x00280010, b"US", b"\x05\x00")
    assert dicom.parse(raw)["rows"] == 5 and "sop_uid" not in dicom.parse(raw)


def test_dicom_files_without_preamble():
    els = [(0x00280010, b"US", b"\x03\x00"), (0x00281053, b"DS", b"1.5"), (0x00080008, b"CS", b"ORIGINAL\\PRIMARY"), (0x7FE00010, b"OW", bytes(4))]
    for syntax in (dicom.EXPLICIT, dicom.IMPLICIT):
        raw = dicom.write(els, syntax)
        meta = len(dicom.write([], syntax))
        for part in (raw[132:], raw[meta:]):
            got = dicom.parse(part)
            assert (got["syntax"], got["rows"], got["rescale_slope"], got["image_type"], got["has_pixels"]) == (syntax, 3, 1.5, ["ORIGINAL", "PRIMARY"], True)


def test_dicom_unknown_values_and_fragments():
    end, item = b"\xfe\xff\xdd\xe0\0\0\0\0", b"\xfe\xff\x00\xe0"
    inner = dicom.element(0x00280010, b"US", b"\x09\x00", explicit=False)
    unknown = b"\x09\x00\x01\x10UN\0\0\xff\xff\xff\xff" + item + len(inner).to_bytes(4, "little") + inner + end
    fragments = item + bytes(4) + item + b"\x06\0\0\0" + b"abcdef"
    pixels = b"\xe0\x7f\x10\x00OB\0\0\xff\xff\xff\xff" + fragments
    behind = dicom.element(0x7FE10010, b"LO", b"x")
    start = dicom.write([]) + unknown + dicom.element(0x00280010, b"US", b"\x05\x00")
    raw = start + pixels + end + behind
    got = dicom.parse(raw)
    assert got["rows"] == 5 and got["encapsulated"] and raw[got["value_start"] : got["value_end"]] == fragments
    for broken in (start + pixels, start + pixels[:-2] + end, start + end):
        with pytest.raises(ValueError):
            dicom.parse(broken)


def test_range_headers(spark):
    specs = [("bytes=0-0", 10, (0, 0)), ("bytes=5-", 10, (5, 9)), ("bytes=-3", 10, (7, 9)), ("bytes=-30", 10, (0, 9)), ("bytes=2-100", 10, (2, 9)), ("bytes=10-", 10, None), ("bytes=0-1,3-4", 10, None), ("bytes=-0", 10, None), ("bytes=4-2", 10, None), ("x=1-2", 10, None), ("bytes=0-", 0, None)]
    df = spark.createDataFrame([(s, n) for s, n, _ in specs], "s string, n long")
    got = [tuple(r[0]) if r[0] else None for r in df.select(T.parse_range(F.col("s"), F.col("n"))).collect()]
    assert got == [w for _, _, w in specs]


def test_versions_and_deletes(spark):
    log = spark.createDataFrame([("b", "k", 1, 10, 5, 1, False), ("b", "k", 2, 20, 6, 1, True), ("b", "j", 3, 30, 7, 1, False)], "bucket string, key string, seq long, t long, size long, series long, deleted boolean")
    assert [r["key"] for r in index.live(log).collect()] == ["j"]
    assert index.current(log).count() == 2


def test_streaming_sessions(spark, data, tmp_path):
    from stratavox.streaming import compaction

    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts")
    events.write.parquet(str(tmp_path / "in"))
    q = compaction.run(compaction.quiet_series(compaction.puts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    log = index.object_log(events)
    want = index.quiet_sessions(log.where("NOT deleted"), 7200)
    closed = {(r["series"], r["n"], r["bytes"]) for r in got.collect()}
    assert closed and closed <= {(r["series"], r["n"], r["bytes"]) for r in want.collect()}


def test_http_dates_and_spacing(spark):
    df = spark.createDataFrame([(0,), (784111777,), (-5,)], "t long")
    assert [r[0] for r in df.select(T.http_date(F.col("t"))).collect()] == ["Thu, 01 Jan 1970 00:00:00 GMT", "Sun, 06 Nov 1994 08:49:37 GMT", "Thu, 01 Jan 1970 00:00:00 GMT"]
    from stratavox.operators.stacks import slice_spacing

    p = spark.createDataFrame([([0.0, 0.0, 1.0], [3.0, 4.0, 1.0]), (None, [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in p.select(slice_spacing(F.col("a"), F.col("b"))).collect()] == [5.0, None]


def test_numpy_in_and_out(spark):
    t = volume(3, 4, 5).astype("<i2")
    assert (V.to_numpy(V.from_numpy(spark, t, "v", 13)) == t).all()
    with pytest.raises(ValueError, match="outside"):
        V.from_numpy(spark, t, "v", 3)
    assert network.exponents(0.5, 10.0, 4) == (7, 3, 8) and network.exponents(100.0, 0.01, 0)[2] == 0


def test_described_volumes(tmp_path, spark):
    import json

    for name, split in (("a", "train"), ("b", "test"), ("c", "test")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "split": split, "modality": "CT"}))
        (tmp_path / f"{name}.npy").write_bytes(arrays.write_npy(volume(2, 3, 4).astype("<i2")))
    got = arrays.described(spark, str(tmp_path), split="test", exclude=("c",)).collect()
    assert {(r["id"], r["modality"], r["z"]) for r in got} == {("b", "CT", 0), ("b", "CT", 1)}


def test_splits_and_summaries(spark):
    from stratavox.operators import evaluation as E

    df = spark.range(2000)
    share = df.select(F.avg(E.validation(F.col("id"), 0.25).cast("int"))).first()[0]
    assert 0.2 < share < 0.3
    s = spark.createDataFrame([("a", 1), (None, 2)], "g string, n int")
    assert [r[0] for r in E.as_table(s).collect()] == ["| a | 1 |", "|  | 2 |"] and '"n":1' in E.as_json(s).first()[0]


def test_command_line(capsys):
    from stratavox.__main__ import main

    assert main(["no such query", "x"]) == 2 and "volume_stats" in capsys.readouterr().err
