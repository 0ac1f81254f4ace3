"""Language identification by multinomial naive Bayes (operator 4).

Character n-grams of 1 to 4 code points of the A-Z-lower-cased text are hashed into
BUCKETS. Training counts n-grams per language over a sample of the training fold,
about PER_LANGUAGE rows of each language (chosen by a hash of the id, all rows of a
language that has fewer, so that rare languages are learned too), dealt over FOLDS
tasks; each folds its rows into one count vector per language, and the driver
receives languages x BUCKETS numbers, whatever the corpus size. The smoothed
log-probability matrix is broadcast; a block of texts is scored by summing the
matrix's rows at its n-grams, document by document. The prior is each language's
share of all labelled training rows; the score is the posterior of the language.

The matrix is bounded: with more than MAX_LANGUAGES languages neighbouring buckets are
added up until languages x buckets fit into MAX_LANGUAGES x BUCKETS float32 (64 MB).

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text when nothing was learned; languages are ordered by name, and a tie goes
to the first; rows with a null id, text or language teach nothing; repeated rows count
and are scored each; a very long text is scored in steps of STEP characters, whole;
empty tables give no rows; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Block, blocks, mix
from ._common import cut, trainable

BUCKETS, ORDERS, MAX_LANGUAGES, SMOOTHING = 1 << 16, (1, 2, 3, 4), 256, 0.5
#: Bounds of the training sample: expected rows of a language, and tasks that count them.
PER_LANGUAGE, FOLDS = 10_000, 16
#: Languages with their numbers of rows are broadcast up to so many.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
#: Characters whose n-grams are hashed at once.
STEP = 1 << 18
_PART = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Which code points are letters (Unicode L)."""
    every = "".join(map(chr, range(0x110000))).encode("utf-8", "replace").decode()
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"\p{L}", every)]] = True
    return out


_LETTER: list[np.ndarray] = []


def code_points(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block, and the bounds of each document's."""
    points = np.frombuffer(b.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum(b.sums((b.buf & 0xC0) != 0x80))]


def grams(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step and order: the buckets of n-grams, the documents that have some there, and where each one's begin."""
    for lo in range(0, len(points), STEP):
        hi = min(lo + STEP, len(points))
        part = mix(points[lo : hi + max(ORDERS) - 1].astype(np.uint64) + np.uint64(1))
        first, last = np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi, side="left")
        begin = np.clip(bounds[first:last], lo, hi)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            code = code[: max(0, len(part) - n + 1)] * _BASE + part[n - 1 :]
            if n not in ORDERS:
                continue
            size = np.maximum(np.minimum(bounds[first + 1 : last + 1] - n + 1, hi) - begin, 0)  # n-grams that lie within a document
            some = np.flatnonzero(size)
            if not len(some):
                continue
            size, head = size[some], np.cumsum(size[some]) - size[some]
            at = np.repeat(begin[some] - lo - head, size) + np.arange(int(size.sum()))
            yield (mix(code[at] + np.uint64(n)) >> np.uint64(48)).astype(np.int64) % BUCKETS, first + some, head


def training_sample(docs: DataFrame, most: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(text, lang) of about `most` labelled training rows of each language, or of all when there are fewer; and (lang, rows)."""
    rows = docs.where(trainable(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).where("text IS NOT NULL AND lang IS NOT NULL")
    many = cut(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    if many.count() > MOST_BROADCAST:
        return rows.join(many, "lang").where(place * F.col("rows") < most).select("text", "lang"), many
    many = F.broadcast(many)
    return rows.join(many, "lang").where(place * F.col("rows") < most).select("text", "lang"), many


def count_languages(sample: DataFrame) -> DataFrame:
    """(lang, part, counts array<bigint>): n-gram counts of the sample; part p holds buckets from p * 4096."""

    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for b in blocks(batch.column(0), lower=True):
                own = langs[b.first : b.first + b.n]
                for bucket, docs, head in grams(*code_points(b)):
                    size = np.diff(np.r_[head, len(bucket)])
                    for lang in set(own[docs]):
                        of = np.repeat(own[docs] == lang, size)
                        counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        counts[lang] += np.bincount(bucket[of], minlength=BUCKETS)
        for lang, c in counts.items():
            parts = [c[i : i + _PART].tolist() for i in range(0, BUCKETS, _PART)]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(parts), "part": list(range(len(parts))), "counts": parts}, schema=schema)

    def add(parts: pa.Table) -> pa.Table:  # FOLDS rows at most
        total = np.sum(parts.column("counts").to_pylist(), axis=0)
        return pa.Table.from_pydict({"lang": parts.column("lang").to_pylist()[:1], "part": parts.column("part").to_pylist()[:1], "counts": [total.tolist()]}, schema=schema)

    spec = "lang string, part int, counts array<bigint>"
    return sample.repartition(FOLDS).mapInArrow(fold, spec).groupBy("lang", "part").applyInArrow(add, spec)


class Model:
    """Log-probabilities of buckets (rows) by language (columns), with the log-prior."""

    def __init__(self, counts: list[tuple[str, int, list[int]]], rows: dict[str, int]):
        self.langs = sorted(rows)
        self.buckets = BUCKETS
        while self.buckets * len(self.langs) > BUCKETS * MAX_LANGUAGES and self.buckets > 1:
            self.buckets //= 2
        table = np.zeros((self.buckets, len(self.langs)))
        place = {x: i for i, x in enumerate(self.langs)}
        for lang, part, c in counts:
            np.add.at(table[:, place[lang]], (part * _PART + np.arange(len(c))) % self.buckets, c)
        self.logp = (np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * self.buckets)).astype(np.float32)
        docs = np.array([rows[x] for x in self.langs], float)
        self.prior = np.log(docs) - np.log(docs.sum()) if len(docs) else docs

    def score(self, texts: pa.Array) -> pa.Array:
        if not _LETTER:
            _LETTER.append(_letters())
        pred, score = [], []
        for b in blocks(texts, lower=True):
            points, bounds = code_points(b)
            spelled = np.flatnonzero(np.diff(bounds))
            letters = np.zeros(b.n, bool)
            if len(spelled):
                letters[spelled] = np.add.reduceat(_LETTER[0][points], bounds[spelled], dtype=np.int64) > 0
            total = np.tile(self.prior, (b.n, 1))
            for bucket, docs, head in grams(points, bounds):
                bucket %= self.buckets
                for k in range(len(self.langs)):
                    total[docs, k] += np.add.reduceat(self.logp[:, k][bucket], head, dtype=np.float64)
            if not self.langs:
                letters[:] = False
            best = total.argmax(axis=1) if self.langs else np.zeros(b.n, int)
            post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if self.langs else np.zeros(b.n)
            pred += [self.langs[k] if sure else UNKNOWN for k, sure in zip(best.tolist(), letters.tolist(), strict=True)]
            score += np.where(letters, post, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])


def fit(docs: DataFrame) -> Model:
    """The model of the training fold; what reaches the driver is bounded by languages x BUCKETS."""
    sample, many = training_sample(docs)
    return Model([tuple(r) for r in count_languages(sample).collect()], {r[0]: r[1] for r in many.collect()})


def predict(docs: DataFrame, model: Model, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda texts: shared.value.score(texts), "struct<lang_pred:string,score:double>")(text.cast("string"))
