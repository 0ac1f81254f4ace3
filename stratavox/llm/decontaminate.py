"""Benchmark decontamination by word windows (operator 2).

The normalised windows of the benchmark are hashed into a sorted array that is
broadcast while their number stays within MAX_BROADCAST_WINDOWS; documents are
scanned window by window against it, and every hash hit is verified on its
words. A larger benchmark takes the join path: windows of distinct texts are
joined to the benchmark's windows on the window itself.

Defined cases: a null or empty text has no words and is never hit; a null or
word-less item has no window; an item of fewer than WINDOW words is one window
of all its words; rows of one item_id count as one item; items without an id
mark words as hit but are not listed; repeated document rows are each reported;
an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, span_hashes, windows, words
from ._common import once

WINDOW = 10
#: 200,000 windows of ten words are about 30 MB with their words.
MAX_BROADCAST_WINDOWS = 200_000
#: What contamination() adds to a document.
_TYPE = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,spans:array<struct<start:int,end:int>>>"
_TABLE_BITS = 20


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item string, size int, win binary): each item's windows, words joined by a space."""

    @F.arrow_udf("array<struct<size:int,win:binary>>")
    def cutter(texts: pa.Array) -> pa.Array:
        out: list = [[] for _ in range(len(texts))]
        for b in blocks(texts, lower=True):
            starts, ends, docs = words(b)
            raw = b.buf.tobytes()
            own = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            bounds = np.searchsorted(docs, np.arange(b.n + 1)).tolist()
            for d in range(b.n):
                w = own[bounds[d] : bounds[d + 1]]
                n = min(window, len(w))
                out[b.first + d] = [{"size": n, "win": b" ".join(w[i : i + n])} for i in range(len(w) - n + 1)] if w else []
        return pa.array(out, pa.list_(pa.struct([("size", pa.int32()), ("win", pa.binary())])))

    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), once(cutter)(F.col(text_col).cast("string")).alias("w"))
    return cut.select("item", F.explode("w").alias("w")).select("item", "w.size", "w.win").distinct()


class WindowIndex:
    """Sorted hashes of windows by size, with each window's words and items."""

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        items: dict[bytes, set] = {}
        for item, _, win in rows:
            items.setdefault(bytes(win), set()).add(item)
        self.by_size: dict[int, tuple[np.ndarray, list[tuple[bytes, list]], np.ndarray]] = {}
        for size in sorted({n for _, n, _ in rows}):
            wins = sorted(w for w in items if w.count(b" ") + 1 == size)
            keys = np.array([self._key(w) for w in wins], np.uint64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[keys >> np.uint64(64 - _TABLE_BITS)] = True
            self.by_size[size] = keys[order], [(wins[i], sorted(x for x in items[wins[i]] if x is not None)) for i in order], seen

    @staticmethod
    def _key(win: bytes) -> int:
        buf = np.frombuffer(win, np.uint8)
        cuts = np.flatnonzero(buf == 0x20)
        h = span_hashes(buf, np.r_[0, cuts + 1], np.r_[cuts, len(buf)])
        return int(windows(h, np.zeros(len(h), int), len(h))[0][0])

    def scan(self, texts: pa.Array) -> pa.Array:
        n_words, n_hit, found, spans = [], [], [], []
        for b in blocks(texts, lower=True):
            starts, ends, docs = words(b)
            hashes, raw = span_hashes(b.buf, starts, ends), b.buf.tobytes()
            delta, items = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(b.n)]
            for size, (keys, wins, seen) in self.by_size.items():
                key, inside = windows(hashes, docs, size)
                if not len(key):
                    continue
                likely = np.flatnonzero(inside & seen[key >> np.uint64(64 - _TABLE_BITS)])
                first = np.searchsorted(keys, key[likely])
                ok = first < len(keys)
                likely, first = likely[ok], first[ok]
                ok = keys[first] == key[likely]
                for i, j in zip(likely[ok].tolist(), first[ok].tolist(), strict=True):
                    own = b" ".join(raw[starts[k] : ends[k]] for k in range(i, i + size))
                    while j < len(keys) and keys[j] == key[i]:
                        if wins[j][0] == own:
                            items[docs[i]].update(wins[j][1])
                            delta[i] += 1
                            delta[i + size] -= 1
                            break
                        j += 1
            hit = np.cumsum(delta[:-1]) > 0
            n_words.append(np.bincount(docs, minlength=b.n))
            n_hit.append(np.bincount(docs[hit], minlength=b.n))
            found += items
            edge = hit & ~np.r_[False, hit[:-1] & (docs[1:] == docs[:-1])] if len(hit) else hit
            last = hit & ~np.r_[hit[1:] & (docs[1:] == docs[:-1]), False] if len(hit) else hit
            own_spans: list = [[] for _ in range(b.n)]
            for s, e, d in zip(starts[edge].tolist(), ends[last].tolist(), docs[edge].tolist(), strict=True):
                own_spans[d].append({"start": s - int(b.offs[d]), "end": e - int(b.offs[d])})
            spans += own_spans
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        hits = flat(n_hit)
        return pa.StructArray.from_arrays(
            [
                flat(n_words), hits, pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found], pa.string()),
                pa.array([x > 0 for x in hits.to_pylist()], pa.bool_()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "contamination", window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """docs with a struct column `out`; spans are byte ranges of hit word runs in the UTF-8 text."""
    wins = benchmark_windows(benchmark, window)
    rows = wins.limit(max_broadcast + 1).collect()
    if len(rows) > max_broadcast:
        return _joined(docs, wins, text_col, out)
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex([tuple(r) for r in rows]))

    @F.arrow_udf(_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        return index.value.scan(texts)

    return docs.withColumn(out, scan(F.col(text_col).cast("string")))


def _joined(docs: DataFrame, wins: DataFrame, text_col: str, out: str) -> DataFrame:
    """The same by joins, for a benchmark too large to broadcast: windows of distinct texts meet the benchmark's windows."""
    sizes = [r[0] for r in wins.select("size").distinct().collect()]  # at most WINDOW values
    text = F.col(text_col).cast("string")

    @F.arrow_udf("struct<n:bigint,starts:array<int>,ends:array<int>,cuts:array<struct<at:int,size:int,win:binary>>>")
    def cutter(texts: pa.Array) -> pa.Array:
        got = []
        for b in blocks(texts, lower=True):
            starts, ends, own = words(b)
            raw, bounds = b.buf.tobytes(), np.searchsorted(own, np.arange(b.n + 1))
            for d in range(b.n):
                s, e = starts[bounds[d] : bounds[d + 1]], ends[bounds[d] : bounds[d + 1]]
                w = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                got.append({"n": len(w), "starts": (s - b.offs[d]).tolist(), "ends": (e - b.offs[d]).tolist(), "cuts": [{"at": i, "size": n, "win": b" ".join(w[i : i + n])} for n in sizes for i in range(len(w) - n + 1)]})
        cuts = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("win", pa.binary())]))
        return pa.array(got, pa.struct([("n", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("cuts", cuts)]))

    @F.arrow_udf(_TYPE)
    def gather(n: pa.Array, starts: pa.Array, ends: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        rows = []
        for size, s, e, h, own in zip(n.to_pylist(), starts.to_pylist(), ends.to_pylist(), hits.to_pylist(), items.to_pylist(), strict=True):
            hit = np.zeros(size + 1, np.int64)
            for x in h or []:
                hit[x["at"]] += 1
                hit[x["at"] + x["size"]] -= 1
            on = np.r_[0, np.cumsum(hit[:-1]) > 0, 0]
            firsts, lasts = np.flatnonzero(np.diff(on) > 0), np.flatnonzero(np.diff(on) < 0) - 1
            own = sorted(own or [])
            rows.append({"n_words": size, "n_hit": int(on.sum()), "n_items": len(own), "items_sha256": hashlib.sha256(",".join(own).encode()).hexdigest(), "contaminated": bool(on.any()), "spans": [{"start": s[i], "end": e[j]} for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True)]})
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", span)]))

    key = F.sha2(F.coalesce(text, F.lit("")), 256)
    texts = docs.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("t")).dropDuplicates(["key"]).select("key", once(cutter)("t").alias("c")).select("key", "c.*")
    hits = texts.select("key", F.explode("cuts").alias("c")).select("key", "c.*").join(wins, ["size", "win"])
    per = hits.groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("hits"), F.collect_set("item").alias("items"))
    done = texts.drop("cuts").join(per, "key", "left").select(F.col("key").alias("__key"), gather("n", "starts", "ends", "hits", "items").alias("__out"))
    return docs.withColumn("__own", key).join(done, F.col("__own") == F.col("__key"), "left").withColumn(out, F.col("__out")).drop("__own", "__key", "__out")


def remove_spans(df: DataFrame, text_col: str = "text", out: str = "contamination") -> DataFrame:
    """df with the hit word runs cut from its texts; `out` is the column made by contamination()."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept = []
        for t, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and own:
                raw, at, parts = t.encode(), 0, []
                for x in own:
                    parts.append(raw[at : x["start"]])
                    at = x["end"]
                t = b"".join([*parts, raw[at:]]).decode()
            kept.append(t)
        return pa.array(kept, pa.string())

    return df.withColumn(text_col, without(F.col(text_col).cast("string"), F.col(f"{out}.spans")))


ORACLE = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
  FROM item WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
cuts AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM doc, (SELECT DISTINCT size FROM win)),
hits AS (
  SELECT r, pos, win.size, item FROM (SELECT r, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM cuts) c JOIN win USING (size, win)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
