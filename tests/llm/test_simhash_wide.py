"""The pipeline's near-duplicates against all pairs in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from stratavox.llm import simhash_wide as wide

DATA = "/root/testdata/sf0.01"


def grams(t):
    w = "".join(c.lower() if c < "\x80" else c for c in t or "").split(" ")
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("seed", [5, 6])
def test_all_near_copies_are_found(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for g in range(25):  # chains of copies about the bound, and a line that many share
        own = ["all", "share", "this", "long", "line", "of", "words"] * (g % 2) + [word() for _ in range(rng.choice([rng.randrange(5, 30), rng.randrange(20, 120), rng.randrange(120, 700)]))]
        for _ in range(8):
            rows.append((len(rows), " ".join(own)))
            for _ in range(rng.randrange(1 + len(own) // 40 + rng.randrange(4))):
                own[rng.randrange(len(own))] = word()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.dedup_stage(spark, df, "").collect()) == brute(rows)


def test_parts_outnumber_differences_up_to_143_shingles():
    n = np.arange(0, 144)
    assert ((1 << wide.level_of(n)) > 2 * n // 9).all() and (1 << wide.level_of(n)).max() == wide.SEGMENTS
    more = np.arange(144, 50_000)
    per = more / (1 << wide.level_of(more))
    assert per.max() < 9 and per[more >= 288].min() >= 4.5 and (np.diff(wide.level_of(np.arange(9999))) >= 0).all()


def test_chains_within_proportional_budgets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (40, wide.SEGMENTS), np.uint64)
    flips = np.packbits(rng.random((40, wide.SEGMENTS, 64)) < rng.choice([0.05, 0.25, 0.32, 0.5], (40, 1, 1)), axis=2).view(np.uint64)[:, :, 0]
    b, start = a ^ flips, rng.integers(0, wide.SEGMENTS, 40)
    lists = lambda x: pa.array(x.view(np.int64).tolist(), pa.list_(pa.int64()))
    got = wide.chain_array(lists(a), lists(b), pa.array(start)).to_pylist()
    for i in range(40):
        d = [bin(int(x ^ y)).count("1") for x, y in zip(a[i], b[i], strict=True)]
        ok = all(sum(d[(int(start[i]) + k) % wide.SEGMENTS] for k in range(n)) <= n * wide.BUDGET for n in range(1, wide.SEGMENTS + 1))
        assert got[i] == ok
    assert any(got) and not all(got)


def test_near_copies_of_the_tables(spark):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = [(i, " ".join((x or "").split(None))) for i, x in zip(t["doc_id"], t["text"], strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.dedup_stage(spark, df, "").collect()) == brute(rows)
