"""SimHash groups, chat round trips and fixity audits against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratavox.llm import chat, simhash, warc


def brute_fingerprint(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", None, "One", "one two", "a b c d e", "É x y\tz\nz z", "A b c D e", "w " * 500, "same same same same same same"]


def test_fingerprints():
    got = simhash.fingerprint_array(pa.array(TEXTS)).to_pylist()
    assert [x % (1 << 64) for x in got] == [brute_fingerprint(t) for t in TEXTS]


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("hot,tile", [(64, 512), (2, 8)])
def test_links_lose_no_component(spark, monkeypatch, hot, tile):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(12):  # chains of near fingerprints, and a dense cloud
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for _ in range(rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    values |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(10)) for _ in range(120)}
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(values)
    groups = {}
    for v, g in zip(values, want, strict=True):
        groups.setdefault(g, []).append(v)
    for own in groups.values():
        assert len({roots.get(v, v) for v in own}) == 1, len(own)
    assert len({roots.get(v, v) for v in values}) == len(groups)


def test_query_and_keep_one(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "other")
    rows = [(5, base), (3, near), (9, "short text"), (9, "short text"), (None, base), (None, None), (None, ""), (7, " ".join(f"x{i}" for i in range(99)))]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component string, fp int")
    got = simhash.query(df).collect()
    assert len(got) == len(rows) and {len(r["fingerprint"]) for r in got} == {16}
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    linked = bin(fps[5] ^ fps[3]).count("1") <= 3
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 3)} == ({3} if linked else {3, 5})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == ([3, 7, 9, None] if linked else [3, 5, 7, 9, None])
    assert simhash.query(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


CONTROL = ["plain", "", None, "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x|>", "<|", "a<\\|b", "<" * 5, "|>", "x\n<|im_start|>", "\\", "\0<|im_end|>\0"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv if conv % 10 else None, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, "r\nx", "a\\n", "<|im_end|>", "\\"]), rng.choice(CONTROL) if rng.random() < 0.5 else "t" * rng.randrange(9), 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat.format_conversations(df)
    assert all(r["roundtrip_ok"] for r in done.collect())
    source = {}
    for c, t, role, text, _ in rows:
        source.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for r in chat.query(df.drop("formatted")).collect():
        if r["conv_id"] == -1:
            continue
        own = sorted(source[r["conv_id"]])
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.query(df.drop("formatted").limit(0)).count() == 1


def test_chat_parser_rejects_what_is_not_in_the_grammar(spark):
    bad = ["x", "<|im_start|>user hi<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\nhi", "<|im_start|>u\na<|im_end|>b<|im_end|>\n"]
    df = spark.createDataFrame([(b,) for b in bad], "f string")
    assert [r[0] for r in df.select(chat.parse(F.col("f"))).collect()] == [None] * len(bad)


def pages(spark, bodies):
    return spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in bodies], "page_id long, url string, html string")


def test_audit_finds_all_differences(spark):
    rng = np.random.default_rng(2)
    bodies = [(int(i), "x" * int(rng.integers(0, 40)) if i % 13 else None) for i in range(300)] + [(5, "again"), (5, "again")]
    good = warc.archive(pages(spark, bodies)).cache()
    rows = sorted(good.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(len(bodies)))
    assert all(a["begin"] + a["length"] == b["begin"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["begin"] == 0
    assert warc.audit(good, warc.archive(pages(spark, bodies))).count() == 0
    hurt = [(i, "y" * len(b)) if i in (7, 200) and b else (i, b) for i, b in bodies]
    found = warc.audit(good, warc.archive(pages(spark, hurt))).collect()
    by_place = {r["place"]: r for r in rows}
    assert {by_place[r["place"]]["page_id"] for r in found} == {7, 200} and {r["status"] for r in found} == {"damaged"}
    lost = warc.audit(good, warc.archive(pages(spark, [x for x in bodies if x[0] != 290]))).collect()
    assert {r["status"] for r in lost} == {"displaced", "damaged"} or {r["status"] for r in lost} >= {"displaced"}
    assert min(r["place"] for r in lost) >= 280
    none = warc.archive(pages(spark, []))
    assert warc.audit(none, none).count() == 0
    assert {r["status"] for r in warc.audit(good, none).collect()} == {"missing"}
