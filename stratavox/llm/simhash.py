r"""SimHash near-dedup with pigeonring filtering (operator 5).

Words are runs of anything but ASCII white space in the A-Z-lower-cased text;
each 3-word shingle is hashed with XXH64 (seed 42) and a fingerprint bit is set
if it is set in over half of the shingles' hashes. Fingerprints link at
Hamming distance 3 or less and documents are grouped by reachability.

Candidates. The 64 bits form a ring of 8 segments. If two fingerprints differ in
3 bits at most, a segment i exists from which every chain of l segments differs
in at most floor(3 l / 8) bits (the strong pigeonring principle). Chains of
2 to 5 segments have budgets 0, 1, 1, 1: segments i and i+1 agree, and two of
i+2, i+3, i+4 agree. So 8 * 3 keys of 32 bits find all links; a candidate's
whole chain is tested before the full distance.

Scale. Copies are first folded into distinct fingerprints. A key shared by more
than HOT fingerprints is compared in tiles of about TILE x TILE fingerprints, dealt
by a hash, each a group that returns a spanning forest of its links, not its
pairs. Keys are counted with map-side sums and their sizes joined back, so that
no task has to hold all the fingerprints of a key.
Components of the link graph are found by alternating star contractions, each
written to the checkpoint folder.

Defined cases: a null, empty or word-less text has fingerprint zero and links
like any other; fewer than three words are one shingle; a null doc_id never
becomes a component_id unless its whole component has none; repeated rows are
each returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, tokens
from ._common import cut, fresh

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 8
HOT, TILE = 64, 512


def fingerprint_array(texts: pa.Array) -> pa.Array:
    """The 64-bit fingerprints of a column of texts, as signed longs."""
    out = []
    for b in blocks(texts, lower=True):
        starts, ends, docs = tokens(b)
        prints = np.zeros(b.n, np.uint64)
        if len(starts):
            size = ends - starts
            to = np.cumsum(size + 1)
            joined = np.full(int(to[-1]), 0x20, np.uint8)  # every word and a space behind it
            rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            joined[np.repeat(to - size - 1, size) + rank] = b.buf[np.repeat(starts, size) + rank]
            raw, first, last = joined.tobytes(), to - size - 1, to - 1
            head = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])  # each document's first word
            tail = np.r_[head[1:], len(docs)]
            take = np.arange(len(docs)) <= np.repeat(np.maximum(tail - SHINGLE, head), tail - head)
            begin = np.flatnonzero(take)
            end = np.minimum(begin + SHINGLE, np.repeat(tail, tail - head)[begin]) - 1
            digest = xxhash.xxh64_intdigest
            h = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(first[begin].tolist(), last[end].tolist(), strict=True)), np.uint64, len(begin))
            owner = docs[begin]
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
            many = np.diff(np.r_[cuts, len(owner)])[:, None]
            prints[owner[cuts]] = np.packbits(2 * ones > many, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        out.append(prints)
    return pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), pa.int64())


def fingerprint(text: Column) -> Column:
    return F.arrow_udf(fingerprint_array, "bigint")(text.cast("string"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segments: list[int]) -> int:
    width = 64 // SEGMENTS
    return sum(((1 << width) - 1) << width * (s % SEGMENTS) for s in segments)


#: Table 3 i + k: segments i and i+1, and i+2..i+4 without the k-th.
TABLES = [[i, i + 1, *(s for j, s in enumerate((i + 2, i + 3, i + 4)) if j != k)] for i in range(SEGMENTS) for k in range(3)]
_MASKS = [_mask(t) for t in TABLES]


def chain_budgets() -> list[int]:
    return [DISTANCE * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _chain(x: Column, start: int) -> Column:
    """Every chain from segment start stays within its proportional budget."""
    ok = F.lit(True)
    for n, budget in enumerate(chain_budgets()[:-1], 1):
        if n in (2, 5, 7):  # the tightest of equal budgets imply the others
            ok &= F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(list(range(start, start + n))))))) <= budget
    return ok


def tile_links(fps: np.ndarray, other: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links in a tile; fps and other are unsigned and sorted."""
    if not len(fps) or not len(other):
        return []  # a hash may leave one side of a tile empty
    left, right = [], []
    for start in range(0, len(fps), 64):
        x = fps[start : start + 64, None] ^ other[None, :]
        a, b = np.nonzero(np.bitwise_count(x) <= DISTANCE)
        keep = (b > a + start) if same else np.ones(len(a), bool)
        left.append(a[keep] + start)
        right.append(b[keep])
    own = np.concatenate([fps, other[:0] if same else other])
    u, v = np.concatenate(left), np.concatenate(right) + (0 if same else len(fps))
    root = np.arange(len(own))
    edges = []
    while len(u):  # Boruvka-like: hook larger roots on smaller ones, then compress
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        if not len(u):
            break
        big, small = np.maximum(ru, rv), np.minimum(ru, rv)
        order = np.lexsort((small, big))
        first = order[np.r_[True, big[order][1:] != big[order][:-1]]]
        edges += [(own[a], own[b]) for a, b in zip(u[first], v[first], strict=True)]
        root[big[first]] = small[first]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return edges


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links of the distinct fingerprints in column fp."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(_MASKS)])
    index = fps.select("fp", F.explode(keys).alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    tally = index.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    sized = cut(index.join(tally, ["t", "k"]))
    cold = sized.where(F.col("n") <= HOT)
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = cold.select("t", "k", F.col("fp").alias("a")).join(cold.select("t", "k", F.col("fp").alias("b")), ["t", "k"]).where("a < b")
    chained = F.lit(False)
    for i in range(SEGMENTS):
        chained |= F.col("t").between(3 * i, 3 * i + 2) & _chain(x, i)
    found = pairs.where(chained & (F.bit_count(x) <= DISTANCE)).select("a", "b")

    last = F.floor((F.col("n") - 1) / TILE)
    hot = sized.where(F.col("n") > HOT).select("t", "k", "fp", last.cast("int").alias("last"), F.pmod(F.xxhash64("fp"), last + 1).cast("int").alias("i"))
    tiles = hot.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiles = tiles.select("t", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp", (F.col("i") <= F.col("j")).alias("first"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"][pdf["first"]].to_numpy().view(np.uint64))
        other = np.sort(pdf["fp"][~pdf["first"]].to_numpy().view(np.uint64))
        got = tile_links(fp, other, False) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else tile_links(fp, fp, True)
        out = np.array(got, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)}) if len(out) else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return found.union(tiles.groupBy("t", "k", "i", "j").applyInPandas(compare, "a bigint, b bigint")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for the nodes of the undirected edges (a, b)."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if then == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def assign(marked: DataFrame, fp: str, comp: str, id_col: str = "doc_id", edges: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """marked with the struct column comp (root long, id): id is the smallest id of the component under edges."""
    nodes = cut(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least")))
    roots = components(edges(nodes.select("fp")))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("id"))
    of = linked.join(ids, "root").select(F.col("fp").alias("__fp"), F.struct("root", "id").alias(comp))
    return marked.join(of, F.col(fp) == F.col("__fp")).drop("__fp")


def query(docs: DataFrame) -> DataFrame:
    """op5: doc_id, fingerprint, component_id of every document."""
    marked = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    done = assign(marked, "fp", "comp")
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("comp.id").alias("component_id"))


def keep_one(docs: DataFrame, prints: DataFrame | None = None, edges: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest doc_id.

    Of rows that repeat a kept doc_id within a group, one stays; so it does in a
    group without any doc_id. Rows are found again by doc_id and a hash of their
    text, so that texts are read twice but fingerprinted once. Other groups than
    op5's: prints has doc_id, fp and th (the hash of the text), edges links the fps.
    """
    names = {n: fresh(docs, n) for n in ("kept_id", "kept_text", "kept_root", "kept_rows")}
    text = F.xxhash64(F.col("text").cast("string"))
    if prints is None:
        prints = cut(docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), text.alias("th")))
    first = assign(prints, "fp", "comp", edges=edges).where(F.col("doc_id").eqNullSafe(F.col("comp.id"))).groupBy(F.col("comp.root").alias("root"), "doc_id", "th").agg(F.count("*").alias("n"))
    first = first.groupBy("root", "doc_id").agg(F.min_by("th", "th").alias("th"), F.sum("n").alias("n"))
    kept = first.select(F.col("doc_id").alias(names["kept_id"]), F.col("th").alias(names["kept_text"]), F.col("root").alias(names["kept_root"]), F.col("n").alias(names["kept_rows"]))
    kept = cut(kept)
    on = docs["doc_id"].eqNullSafe(kept[names["kept_id"]]) & (text == kept[names["kept_text"]])
    single = docs.join(kept.where(F.col(names["kept_rows"]) == 1), on).select(*docs.columns)
    repeated = docs.join(kept.where(F.col(names["kept_rows"]) > 1), on).dropDuplicates([names["kept_root"]]).select(*docs.columns)
    return single.unionByName(repeated)
