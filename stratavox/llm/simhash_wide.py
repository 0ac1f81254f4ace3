"""SimHash near-dedup at a Jaccard similarity (operator 5 with wide fingerprints).

op5's 64 bits tell apart what differs in 3 bits; texts whose 5-word shingles have a
Jaccard similarity of 0.8 differ in about 15 % of the bits of a SimHash, and no 64
bits can be searched for that. So a fingerprint here is a ring of up to SEGMENTS
segments of 64 bits, each a SimHash (majority of the bits) of its own part of the
text's shingles: the shingles are dealt over 2^level parts by a hash, and part i is
segment i. The level follows the number of shingles, so that a part has few of them.

Candidates. Two texts of similarity 4/5 with n shingles at most differ in 2n/9
shingles at most. Up to 143 shingles there are more parts than that, and all are
segments: one is the same in both, and no pair is missed. Longer texts have 4.5 to
9 shingles in a part, which is the same in both with a probability of 0.14 to 0.37:
of 32 segments all differ in less than 1 pair of 100, at a similarity of 0.8 itself,
and in less than 1 of 10,000 from 0.87 on. Texts near the next level have both levels'
fingerprints. A pair that agrees in segment i is tested by pigeonring: each chain of
segments i, i+1, .. i+l-1 differs in l * BUDGET bits at most, for every l up to the
ring, which is the full Hamming check. (Texts with fewer than SEGMENTS segments have
chains too short to tell and go on at once.) What is left is checked exactly, on the
sets of shingles.

Scale. Copies are first folded into distinct sets. Each key's texts are compared
with its least one (a star), and the components of these links found; then only
texts of different components that share a key are compared, so that a large group
of near copies costs no pairs. A key that more than HOT such texts share is dealt by a
hash into tiles of about TILE x TILE of them; a tile tests all its pairs of different
components by their segments and returns those that pass, so that passages that many
texts share make no rows of them all and no pair is left out. Work on such a key grows
with the square of its texts. (Short texts pass if no more segments differ than their
shingles may.) Sets are made again for candidates only.

Defined cases: null, empty and word-less texts are one group; fewer than SHINGLE
words are one shingle; repeated rows and ties share a group; a null doc_id is kept
only where its group has no other; a very long text has no longer fingerprint than
another; an empty table gives no rows; extra columns, clashing names too, stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._bytes import blocks, mix, span_hashes, tokens, windows
from ._common import cut

SHINGLE, SEGMENTS = 5, 32
#: Bits in which a segment may differ on average: texts of similarity 0.8 differ in about 10 of 64, others in 32.
BUDGET = 20
#: Texts with one key from which on they are compared in tiles, and texts on a tile's side.
HOT, TILE = 64, 512
_PART = np.uint64(0x5851F42D4C957F2D)
_SKETCH = "struct<fp:bigint,n:bigint,level:int,segments:array<bigint>,next_level:int,next_segments:array<bigint>>"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in order, and their bounds by text."""
    out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in blocks(texts, lower=True):
        starts, ends, docs = tokens(b)
        hashes = span_hashes(b.buf, starts, ends)
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, int)
        count = np.diff(np.r_[first, len(docs)])
        keys, own = [], []
        for n in range(1, SHINGLE + 1):
            key, inside = windows(hashes, docs, n)
            at = np.flatnonzero(inside) if n == SHINGLE else first[count == n]
            keys.append(key[at])
            own.append(docs[at])
        key, doc = np.concatenate(keys), np.concatenate(own)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        out.append(key[new])
        sizes.append(np.bincount(doc[new], minlength=b.n))
    return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(sizes))]


def level_of(n: np.ndarray) -> np.ndarray:
    """The least j such that n is below 4.5 * 2^j, from 32 parts on below 9 * 2^j."""
    j = np.maximum(np.floor(np.log2(np.maximum(n, 1) / 4.5)).astype(np.int64) + 1, 0)
    return np.where(j > 5, np.maximum(j - 1, 5), j)


def segments_of(keys: np.ndarray, bounds: np.ndarray, level: np.ndarray) -> np.ndarray:
    """SEGMENTS SimHashes of 64 bits for each set; 0 for a part without shingles and beyond 2^level."""
    out = np.zeros((len(level), SEGMENTS), np.uint64)
    of = np.repeat(np.arange(len(level)), np.diff(bounds))
    shift = np.uint64(63) - np.minimum(level, 63)[of].astype(np.uint64)
    part = (mix(keys ^ _PART) >> np.uint64(1)) >> shift
    use = np.flatnonzero(part < SEGMENTS)
    slot = of[use] * SEGMENTS + part[use].astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, h = slot[order], mix(keys[use][order])
    if len(slot):
        cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        many = np.diff(np.r_[cuts, len(slot)])[:, None]
        value = np.packbits(2 * ones > many, axis=1).view(">u8").reshape(-1).astype(np.uint64)
        out.reshape(-1)[slot[cuts]] = np.maximum(value, 1)  # 0 is for no shingles
    return out


def _lists(values: np.ndarray, bounds: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None else pa.array(null)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)), mask=mask)


def sketch_array(texts: pa.Array) -> pa.Array:
    keys, bounds = shingle_sets(texts)
    n = np.diff(bounds)
    sums = np.r_[np.uint64(0), np.cumsum(mix(keys), dtype=np.uint64)]
    fp = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))
    level, above = level_of(n), level_of(-(-5 * n // 4))
    rows = [segments_of(keys, bounds, x) for x in (level, above)]
    ends = np.arange(len(n) + 1) * SEGMENTS
    same = above == level
    return pa.StructArray.from_arrays(
        [pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(level.astype(np.int32)), _lists(rows[0].reshape(-1), ends), pa.array(above.astype(np.int32), mask=same), _lists(rows[1].reshape(-1), ends, same)],
        names=["fp", "n", "level", "segments", "next_level", "next_segments"],
    )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and the sketch's columns; fp is a hash of the set."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.arrow_udf(sketch_array, _SKETCH)(text).alias("s")).select("doc_id", "th", "s.*")


def _each(lists: pa.Array) -> list[np.ndarray]:
    flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    return [flat[s - at[0] : e - at[0]] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def chain_array(left: pa.Array, right: pa.Array, start: pa.Array) -> pa.Array:
    """Whether every chain from segment `start` stays within its proportional budget."""
    a, b = (np.asarray(x.flatten()).reshape(-1, SEGMENTS).view(np.uint64) for x in (left, right))
    differ = np.bitwise_count(a ^ b).astype(np.int64)
    ring = (np.asarray(start)[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    sums = np.cumsum(np.take_along_axis(differ, ring, axis=1), axis=1)
    return pa.array((sums <= BUDGET * np.arange(1, SEGMENTS + 1)).all(axis=1))


def tile_pairs(segments: np.ndarray, n: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, level: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of left x right, of different groups, that sizes and segments allow to be of similarity 4/5: by chains from `start`, or for short texts by the number of segments that differ."""
    out = [np.zeros((0, 2), np.int64)]
    budget = BUDGET * np.arange(1, SEGMENTS + 1)
    for at in range(0, len(left), 16):
        a, b = left[at : at + 16, None], right[None, :]
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        u, v = np.nonzero((group[a] != group[b]) & (5 * small >= 4 * large))
        a, b = left[at + u], right[v]
        x = segments[a] ^ segments[b]
        if level < 5:
            ok = 9 * np.count_nonzero(x, axis=1) <= 2 * large[u, v]
        else:
            differ = np.roll(np.bitwise_count(x), -start, axis=1)
            ok = (np.cumsum(differ, axis=1, dtype=np.int32) <= budget).all(axis=1)
        out.append(np.stack([a[ok], b[ok]], axis=1))
    pairs = np.concatenate(out)
    return pairs[:, 0], pairs[:, 1]


def hot_pairs(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b), a < b, of different components that rows (k, level, i, fp, n, c, size) of hot keys have in common and tile_pairs() leaves."""
    own = nodes.select("fp", F.col("level").alias("own_level"), "segments", "next_segments")
    last = F.floor((F.col("size") - 1) / TILE)
    known = hot.join(own, "fp").select("k", "level", "i", "fp", "n", "c", F.when(F.col("own_level") == F.col("level"), F.col("segments")).otherwise(F.col("next_segments")).alias("segments"), last.cast("int").alias("last"), F.pmod(F.xxhash64("fp"), last + 1).cast("int").alias("p"))
    tiles = known.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiles = tiles.select("k", "level", "i", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "fp", "n", "c", "segments", (F.col("p") <= F.col("q")).alias("first"))

    def compare(t: pa.Table) -> pa.Table:
        number = lambda name: t.column(name).to_numpy()
        fp, first = number("fp"), number("first").astype(bool)
        segments = np.concatenate([np.asarray(c.flatten()) for c in t.column("segments").chunks]).reshape(-1, SEGMENTS).view(np.uint64)
        within = number("x")[0] == number("y")[0]
        left = np.flatnonzero(first)
        a, b = tile_pairs(segments, number("n"), number("c"), left, left if within else np.flatnonzero(~first), int(number("level")[0]), int(number("i")[0]))
        a, b = fp[a], fp[b]
        keep = a < b if within else slice(None)
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return tiles.groupBy("k", "level", "i", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def _overlaps(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(_each(left), _each(right), strict=True)], pa.int64())


def chained(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct (a, b) of pairs (a, b, level, i: the segment that agrees) that the pigeonring filter leaves."""
    pairs = pairs.groupBy("a", "b", "level").agg(F.collect_set("i").alias("i"))  # SEGMENTS numbers at most
    short = pairs.where("level < 5").select("a", "b")
    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("level").alias(f"{x}_level"), F.col("segments").alias(f"{x}_own"), F.col("next_segments").alias(f"{x}_next"))
    of = lambda x: F.when(F.col(f"{x}_level") == F.col("level"), F.col(f"{x}_own")).otherwise(F.col(f"{x}_next"))
    long = pairs.where("level >= 5").join(side("a"), "a").join(side("b"), "b").select("a", "b", of("a").alias("x"), of("b").alias("y"), F.explode("i").alias("i"))
    kept = long.where(F.arrow_udf(chain_array, "boolean")("x", "y", "i")).select("a", "b")
    return short.union(kept).distinct()


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more, by their sets of shingles."""
    pairs = cut(pairs)
    need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(nodes.select("fp", "th"), "fp")
    text = F.col("text").cast("string")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(need, "th").dropDuplicates(["fp"])
    sets = cut(texts.select("fp", F.arrow_udf(lambda t: _lists(*shingle_sets(t)), "array<bigint>")("text").alias("s")))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    shared = F.arrow_udf(_overlaps, "bigint")("x", "y")
    return cut(both.select("a", "b", shared.alias("o"), (F.size("x") + F.size("y")).alias("n")).where(9 * F.col("o") >= 4 * F.col("n")).select("a", "b"))


def keys_of(nodes: DataFrame) -> DataFrame:
    """(k, level, i, fp, n): a row for every segment with shingles."""
    one = lambda level, segments: nodes.select("fp", "n", F.col(level).alias("level"), F.posexplode(segments).alias("i", "segment"))
    rows = one("level", "segments").union(one("next_level", "next_segments")).where("segment <> 0")
    return rows.select(F.xxhash64("level", "i", "segment").alias("k"), "level", "i", "fp", "n")


def _possible(a: Column, b: Column) -> Column:
    """Sizes of sets that a similarity of 4/5 allows."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links of the distinct sets."""
    nodes = cut(prints.drop("doc_id").dropDuplicates(["fp"]))
    keys = keys_of(nodes)
    tally = keys.groupBy("k").agg(F.count("*").alias("m"), F.min(F.struct("fp", "n")).alias("least")).where("m > 1").drop("m")
    shared = cut(keys.join(tally, "k"))
    star = shared.where((F.col("fp") != F.col("least.fp")) & _possible(F.col("n"), F.col("least.n")))
    near = similar(chained(star.select(F.col("least.fp").alias("a"), F.col("fp").alias("b"), "level", "i"), nodes), docs, nodes)

    roots = cut(simhash.components(near))
    placed = cut(shared.join(roots, F.col("fp") == F.col("node"), "left").select("k", "level", "i", "fp", "n", F.coalesce("root", "fp").alias("c")))
    groups = placed.groupBy("k", "c").agg(F.count("*").alias("m")).groupBy("k").agg(F.count("*").alias("parts"), F.max_by("c", "m").alias("major"), F.sum("m").alias("size")).where("parts > 1").select("k", "major", "size")
    open_ = cut(placed.join(groups, "k"))  # every pair of components has one that isn't the major
    hot = hot_pairs(open_.where(F.col("size") > HOT), nodes)  # what many texts of different groups share is a passage
    open_ = open_.where(F.col("size") <= HOT)
    p = open_.where("c <> major").select("k", "level", "i", F.col("fp").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"))
    q = open_.select("k", F.col("fp").alias("q"), F.col("n").alias("qn"), F.col("c").alias("qc"))
    rest = p.join(q, "k").where((F.col("pc") != F.col("qc")) & _possible(F.col("pn"), F.col("qn")))
    cold = chained(rest.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "level", "i"), nodes)
    far = similar(cold.union(hot).distinct(), docs, nodes)
    return near.union(far)


def keep_one(docs: DataFrame) -> DataFrame:
    """simhash.keep_one() for the groups of this module."""
    prints = cut(sketches(docs))
    return simhash.keep_one(docs, prints.select("doc_id", "fp", "th"), lambda _: links(docs, prints))
