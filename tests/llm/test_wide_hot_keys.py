"""Hot segments of the pipeline's near-duplicates: no pair that agrees in one of them only is left out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_simhash_wide import brute

import corpus_pipeline as P
from stratavox.llm import simhash_wide as wide


@pytest.mark.parametrize("tile", [512, 3])
def test_pairs_that_share_a_hot_segment_only_are_found(spark, monkeypatch, tile):
    monkeypatch.setattr(wide, "HOT", 2)
    monkeypatch.setattr(wide, "TILE", tile, raising=False)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(14)], []
    for _ in range(40):  # pairs that differ as much as a similarity of 0.8 allows, with a passage that all share
        own = passage + [word() for _ in range(rng.randrange(22, 55))]
        rows.append((len(rows), " ".join(own)))
        for k in range(16, len(own), 17):
            own[k] = word()
        rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.dedup_stage(spark, df, "").collect()) == brute(rows)


def test_tile_pairs_agree_with_chains():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 1 << 63, (4, wide.SEGMENTS), np.uint64)
    flips = np.packbits(rng.random((60, wide.SEGMENTS, 64)) < rng.choice([0.02, 0.15, 0.3], (60, 1, 1)), axis=2).view(np.uint64)[:, :, 0]
    segments, n, group = base[rng.integers(0, 4, 60)] ^ flips, rng.integers(200, 260, 60), rng.integers(0, 9, 60)
    a, b = wide.tile_pairs(segments, n, group, np.arange(30), np.arange(30, 60), 5, 7)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    want = set()
    for i in range(30):
        for j in range(30, 60):
            d = np.cumsum([int(segments[i, (7 + k) % 32] ^ segments[j, (7 + k) % 32]).bit_count() for k in range(32)])
            if group[i] != group[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and (d <= wide.BUDGET * np.arange(1, 33)).all():
                want.add((i, j))
    assert got == want and want


def test_a_pair_whose_only_common_segment_is_hot_is_linked(spark, monkeypatch):
    monkeypatch.setattr(wide, "HOT", 2)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50000)}"
    texts = []
    for _ in range(400):
        own = [word() for _ in range(284)]
        texts.append(" ".join(own))
        for k in range(20, 284, 48):
            own[k] = word()
        texts.append(" ".join(own))
    sketch = wide.sketch_array(pa.array(texts)).to_pylist()
    segments = np.array([x["segments"] for x in sketch])
    equal = segments[::2] == segments[1::2]
    number = int(np.flatnonzero(equal.sum(axis=1) == 1)[0])
    a, b, i = 2 * number, 2 * number + 1, int(np.flatnonzero(equal[number])[0])
    rows = [(texts[k], sketch[k]) for k in (a, b)]
    for k in (a + 2, a + 4):  # texts of other groups with that segment, one with the least fp
        other = sketch[k] | {"fp": -(1 << 63) + k, "segments": [*segments[k][:i].tolist(), int(segments[a][i]), *segments[k][i + 1 :].tolist()]}
        rows.append((texts[k], other))
    rows = [(t, x | {"next_level": None, "next_segments": None}) for t, x in rows]  # the one level only
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    prints = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(rows)], f"doc_id long, text string, s {wide._SKETCH}").select("doc_id", F.xxhash64("text").alias("th"), "s.*")
    want = tuple(sorted((sketch[a]["fp"], sketch[b]["fp"])))
    assert [tuple(r) for r in wide.links(docs, prints).collect()] == [want]
