"""Tokenising, LM scores and decontamination against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratavox.llm import _bytes as B
from stratavox.llm import decontaminate, lmscore

ODD = ["", None, "a", "  \n\t ", "A b c ÉÈ 7x", "\x00\x1f x\x00y", "日本語 テキスト", "w " * 3000, "x" * 70_000, "end\r\nof, line."]
TEXT = "array"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_spans_are_the_patterns_matches(most):
    got_words, got_tokens = [], []
    for b in B.blocks(pa.array(ODD), lower=True, most=most):
        raw = b.buf.tobytes()
        for found, out in ((B.words(b), got_words), (B.tokens(b), got_tokens)):
            own = [[] for _ in range(b.n)]
            for s, e, d in zip(*found, strict=True):
                own[d].append(raw[s:e].decode())
            out += own
    assert got_words == [words(t) for t in ODD]
    assert got_tokens == [re.findall("[^\x20\x09-\x0d]+", lower(t)) for t in ODD]


def test_hashes_tell_words_apart_and_ignore_their_place():
    (b,) = B.blocks(pa.array(["ab ba ab aab", "ab"]), lower=True)
    s, e, d = B.words(b)
    h = B.span_hashes(b.buf, s, e)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    key, inside = B.windows(h, d, 2)
    assert inside.tolist() == [True, True, True, False]


def brute_scores(texts):
    docs = [words(t) for t in texts]
    c = {n: Counter(tuple(w[i - n + 1 : i + 1]) for w in docs for i in range(n - 1, len(w))) for n in (1, 2, 3)}
    total = sum(c[1].values())
    out = []
    for w in docs:
        score = 0.0
        for i in range(len(w)):
            uvw, vw = tuple(w[i - 2 : i + 1]), tuple(w[i - 1 : i + 1])
            if i >= 2 and c[3][uvw] >= 2:
                score += math.log(c[3][uvw] / c[2][uvw[:2]])
            elif i >= 1 and c[2][vw] >= 2:
                score += math.log(c[2][vw] / c[1][vw[:1]]) + (math.log(0.4) if i >= 2 else 0)
            else:
                score += math.log(c[1][(w[i],)] / total) + min(i, 2) * math.log(0.4)
        out.append((len(w), score))
    return out


def test_lm_scores(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.5, n).clip(0, 50)) for n in rng.integers(0, 60, 60)] + ODD[:7] + ["w1 w2 w3"] * 3
    df = spark.createDataFrame([(i if i % 9 else None, t, 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, block string")
    got = sorted((r["n_words"], round(r["log_score"], 6)) for r in lmscore.score_documents(df.repartition(3)).collect())
    assert got == sorted((n, round(s, 6)) for n, s in brute_scores(texts))
    empty = lmscore.score_documents(df.limit(0))
    assert empty.count() == 0


def brute_contamination(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(window, len(own))
        for j in range(len(own) - n + 1 if own else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[j : j + n]:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [10_000, 3])
def test_decontamination_by_broadcast_and_by_join(spark, most):
    items = [(1, "a b c d e f g h i j k l"), (22, "Short One"), (3, None), (4, "..."), (None, "no id here at all"), (1, "x y z"), (5, "c d e f g h i j k l")]
    texts = ["q a B c d e f g h i j k", "one short one", "short one short one", "x y z x y z", "NO ID here, at all!", None, "", "short", "a b c d e f g h i j k l a b c d e f g h i j k l", "x y z"] + ["short one"] * 5
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, contamination string, key int").drop("contamination")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, max_broadcast=most)
    for r in got.collect():
        c = r["contamination"]
        assert tuple(c[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_contamination(texts[r["doc_id"]], items), texts[r["doc_id"]]
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(got).collect()}
    assert cleaned[1] == "one " and cleaned[5] is None and cleaned[7] == "short"
    assert not any(r["contamination"]["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0), max_broadcast=most).collect())


def test_size_settings():
    assert [lmscore._size(x) for x in ("16m", "134217728b", "1g", "5", "64KB")] == [16 << 20, 128 << 20, 1 << 30, 5, 64 << 10]
