"""Stupid-backoff language-model scores, computed relationally (operator 1).

The corpus scores itself: S(w | u v) = c(u v w) / c(u v) if the trigram was seen
MIN_COUNT times or more, else ALPHA * S(w | v), and so on down to c(w) / N. A
document's score is the sum of the logarithms over its words.

Plan. Documents are folded into blocks of about BLOCK_BYTES of text. A block's
distinct n-grams with their counts are dealt over hash ranges (shards); a
shard's rows are the n-gram count table of that range, and joining it to the
exploded n-grams of the blocks is a lookup of sorted keys. Each block gets its
counts back and sums over its documents. What moves is one 8-byte key (sorted,
as gaps) for a distinct n-gram of a block and one count back, not a row per
occurrence, and an n-gram that is in every document is still one key a block, so
no key is hot. Shards are as many as spark.sql.shuffle.partitions, or one for
every SHARD_BYTES of the input's splits (bounded by
spark.sql.files.maxPartitionBytes) if that is more, so a shard's keys stay within
a task's memory however large the corpus is. Rows are blocks x shards, and never
more than keys.

The documents are scanned twice and must be cut alike: docs should be a table
read from files, or written or checkpointed before (else an error is raised,
never a wrong score).

Defined cases: a null, empty or word-less text has no words, score 0 and a null
mean; history does not cross documents; repeated rows each count and are each
returned; ids may be null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Block, blocks, mix, span_hashes, windows, words
from ._common import cut

ALPHA, MIN_COUNT, BLOCK_BYTES, SHARD_BYTES = 0.4, 2, 9 << 19, 16 << 20


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane and compressed: the upper planes of gaps and counts are nearly empty."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    plain = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _size(setting: str) -> int:
    """Bytes of a size setting such as 16m or 134217728b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def keys_of(hashes: np.ndarray, docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the 1-, 2- and 3-grams that end at each word, and which of them exist; one key per word each."""
    out = []
    for n in (1, 2, 3):
        key, ok = windows(hashes, docs, n)
        pad = min(n - 1, len(hashes))
        out.append((np.r_[np.zeros(pad, np.uint64), mix(key + np.uint64(n))], np.r_[np.zeros(pad, bool), ok]))
    return out


def distinct_keys(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all orders with their counts."""
    return np.unique(np.concatenate([k[ok] for k, ok in grams]), return_counts=True)


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds in sorted keys of the n equal ranges of the hash space."""
    edge = [(i << 64) // n for i in range(n)]
    return np.r_[np.searchsorted(keys, np.array(edge, np.uint64)), len(keys)]


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, pa.Array]]:
    """(id, block, doc ids) of about BLOCK_BYTES each; the id is a digest of what the block holds."""
    held: list[pa.RecordBatch] = []
    size = 0

    def fold() -> Iterator[tuple[int, Block, pa.Array]]:
        whole = pa.Table.from_batches(held).combine_chunks()
        texts, ids = whole.column(1).combine_chunks(), whole.column(0).combine_chunks()
        for b in blocks(texts, lower=True, most=2 * BLOCK_BYTES):
            own = ids.slice(b.first, b.n)
            parts = np.r_[np.array(own.fill_null(-1), np.int64).view(np.uint64), b.offs.astype(np.uint64), np.uint64(len(b.buf))]
            digest = span_hashes(b.buf, np.zeros(1, int), np.array([len(b.buf)])) if len(b.buf) else np.zeros(1, np.uint64)
            yield int(mix(digest + np.bitwise_xor.reduce(mix(parts + np.arange(len(parts), dtype=np.uint64)))).view(np.int64)[0]), b, own

    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield from fold()
            held, size = [], 0
    if held:
        yield from fold()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, words scored by trigram, bigram and unigram, log_score and mean_log_score of every document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    conf = docs.sparkSession.conf
    per_split = -(-_size(conf.get("spark.sql.files.maxPartitionBytes")) // SHARD_BYTES)
    shards = max(int(conf.get("spark.sql.shuffle.partitions")), per_split * rows.rdd.getNumPartitions())

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, _ in _text_blocks(batches):
            starts, ends, own = words(b)
            keys, count = distinct_keys(keys_of(span_hashes(b.buf, starts, ends), own))
            bounds = _shards(keys, shards)
            some = np.flatnonzero(np.diff(bounds)).tolist()
            cuts = [slice(bounds[s], bounds[s + 1]) for s in some]
            gaps = [_planes(np.diff(keys[c], prepend=np.uint64(0))) for c in cuts]
            yield pa.RecordBatch.from_pydict({"block": [block] * len(some), "shard": some, "gaps": gaps, "n": [_planes(count[c].astype(np.uint32)) for c in cuts]}, schema=pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("gaps", pa.binary()), ("n", pa.binary())]))

    def lookup(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_from_planes(g, np.uint64), dtype=np.uint64) for g in part["gaps"]]
        counts = np.concatenate([_from_planes(n, np.uint32) for n in part["n"]])
        table, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, len(table)).astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"block": part["block"], "shard": part["shard"], "counts": [_planes(x) for x in np.split(total[at], cuts)]})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, ids in _text_blocks(batches):
            starts, ends, own = words(b)
            vocabulary, at = np.unique(span_hashes(b.buf, starts, ends), return_inverse=True)
            per_doc = np.bincount(own, minlength=b.n)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([_planes(per_doc.astype(np.uint32))]), pa.array([_planes(np.diff(vocabulary, prepend=np.uint64(0)))]), pa.array([_planes(at.astype(np.uint32))])], names=["block", "ids", "sizes", "words", "at"])

    def add(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        counts = np.concatenate([_from_planes(x, np.uint64) for x in found.sort_values("shard").drop_duplicates("shard")["counts"]]).astype(np.float64) if len(found) else np.zeros(0)
        for ids, sizes, vocabulary, at in zip(texts["ids"], texts["sizes"], texts["words"], texts["at"], strict=True):
            size = _from_planes(sizes, np.uint32).astype(np.int64)
            hashes = np.cumsum(_from_planes(vocabulary, np.uint64), dtype=np.uint64)[_from_planes(at, np.uint32)]
            own = np.repeat(np.arange(len(size)), size)
            grams = keys_of(hashes, own)
            table, _ = distinct_keys(grams)
            if len(table) != len(counts):
                raise RuntimeError("a block was cut differently by the two scans of the documents")
            c1, c2, c3 = (np.where(ok, counts[np.minimum(np.searchsorted(table, k), max(len(table) - 1, 0))] if len(table) else 0.0, 0.0) for k, ok in grams)
            rank = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            tri, bi = c3 >= MIN_COUNT, (c3 < MIN_COUNT) & (c2 >= MIN_COUNT)
            history = np.minimum(rank, 2)
            before2, before1 = np.r_[0.0, c2[:-1]][: len(c2)], np.r_[0.0, c1[:-1]][: len(c1)]
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.where(tri, np.log(c3) - np.log(before2), np.where(bi, (history - 1) * np.log(ALPHA) + np.log(c2) - np.log(before1), history * np.log(ALPHA) + np.log(c1)))
            per = lambda w: np.bincount(own, w, len(size))  # noqa: B023,E731
            out.append(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": size, "n_tri": per(tri).astype(np.int64), "n_bi": per(bi).astype(np.int64), "log_part": per(log)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": [], "n_tri": [], "n_bi": [], "log_part": []})

    tables = rows.mapInArrow(explode, "block bigint, shard int, gaps binary, n binary").groupBy("shard").applyInPandas(lookup, "block bigint, shard int, counts binary")
    texts = rows.mapInArrow(keep, "block bigint, ids array<bigint>, sizes binary, words binary, at binary")
    parts = cut(texts.groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(add, "doc_id bigint, n_words bigint, n_tri bigint, n_bi bigint, log_part double"))
    total = F.lit(float(parts.agg(F.sum("n_words")).first()[0] or 0))
    n_uni = F.col("n_words") - F.col("n_tri") - F.col("n_bi")
    score = F.when(n_uni > 0, F.col("log_part") - n_uni * F.log(total)).otherwise(F.col("log_part"))
    scored = parts.withColumn("n_uni", n_uni).withColumn("log_score", score)
    return scored.select("doc_id", "n_words", "n_tri", "n_bi", "n_uni", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
flat AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM doc),
gram AS (
  SELECT r, i, w, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM flat WINDOW p AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM gram GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM gram WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM gram WHERE u IS NOT NULL GROUP BY u, v, w),
size AS (SELECT count(*) AS n FROM flat),
level AS (
  SELECT r, CASE WHEN c3.n >= 2 THEN 3 WHEN c2.n >= 2 THEN 2 ELSE 1 END AS k,
    CASE WHEN c3.n >= 2 THEN ln(c3.n / h2.n)
         WHEN c2.n >= 2 THEN ln(c2.n / h1.n) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
         ELSE ln(c1.n / size.n) + ln(0.4) * (CASE WHEN u IS NOT NULL THEN 2 WHEN v IS NOT NULL THEN 1 ELSE 0 END) END AS s
  FROM gram CROSS JOIN size JOIN c1 USING (w) LEFT JOIN c2 USING (v, w) LEFT JOIN c3 USING (u, v, w)
    LEFT JOIN c1 h1 ON h1.w = gram.v LEFT JOIN c2 h2 ON h2.v = gram.u AND h2.w = gram.v),
sums AS (
  SELECT r, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 1) AS n1, sum(s) AS s FROM level GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n3, 0)::BIGINT AS n_tri, coalesce(n2, 0)::BIGINT AS n_bi, coalesce(n1, 0)::BIGINT AS n_uni,
  round(coalesce(s, 0), 4) AS log_score, round(s / nullif(len(w), 0), 4) AS mean_log_score
FROM doc LEFT JOIN sums USING (r)
"""
