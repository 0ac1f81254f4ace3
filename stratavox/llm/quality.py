r"""Quality rules with tokeniser fertility (operator 9).

Base rules count words, symbols, repeated lines and repeated 3-word windows. The
verdict on the others comes from public vocabularies, a sentencepiece one with
byte fallback and a byte-level BPE for many languages: with each, a text's
characters per token, its share of byte tokens and the entropy of its tokens are
held against bands of the text's group. A group is the row's language where one
is given, else (or where the language has few rows) the script of most of the
text's letters.

Bands are fitted to all documents that pass the base rules: per group, size class
(quarters of a doubling of the token count, as the entropy of few tokens is low)
and figure, a histogram of fixed bins is counted by Spark, and the band is the
median, FENCE robust standard deviations (from the wider of the quartile
distances) to either side; that of entropy comes from the upper quartile only and
reaches twice as far up, as junk is what repeats itself. A size class takes in its neighbours until it has MIN_ROWS rows; groups
without as many have the outer limits (LIMITS) only, which hold for all. So a few
odd texts decide nothing, and texts unlike the others of their language fall out.

Every distinct word is encoded once per worker and vocabulary and remembered, up
to MEMO_WORDS; a text's token histogram is then a sum over its words. Words are
encoded with the space before them; words over LONG_WORD bytes in parts of so many.

Defined cases: a null, empty or word-less text has zero counts, fails the base
rules and has null fertility figures; texts without letters are of script
``other``; a null language is as no language; a very long text is one block, whose
hashes and tokens are a few numbers a word; ties and repeated rows count each; an
empty table has no bands; extra columns, clashing names too, are left alone.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Block, blocks, in_token, span_hashes, tokens, windows
from ._common import cut, fresh, kept_model, once, tokenizer_path

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
MIN_WORDS, MEMO_WORDS, LONG_WORD = 50, 400_000, 1024
#: A band's half-width in robust standard deviations, the rows that fit one, and size classes a doubling.
FENCE, MIN_ROWS, CLASSES = 4.0, 200, 4
#: Bins of the histograms, per unit: characters per token, byte share, entropy in bits; and the least half-width of a band.
BINS, SLACK = (64, 256, 64), (0.1, 0.05, 0.15)
#: Outer limits of every text: characters per token, byte share, entropy in bits.
LIMITS = ((0.1, 12.0), (0.0, 0.98), (0.0, 64.0))
FIGURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,script:string,size_class:int,chars_per_token:array<double>,byte_share:array<double>,token_entropy:array<double>>"
SCRIPTS = ("latin", "cyrillic", "greek", "cjk", "other")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(b: Block) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a block's documents, and its words."""
    starts, ends, docs = tokens(b)
    hashes = span_hashes(b.buf, starts, ends)
    per = lambda at, weights=None: np.bincount(at, weights, b.n).astype(np.int64)
    inside = in_token(b)
    n_words, chars, symbols = per(docs), b.sums(inside & ((b.buf & 0xC0) != 0x80)), b.sums(_SYMBOL[b.buf])

    line_start, line_end, line_doc = b.spans(b.buf != 0x0A)
    full = np.add.reduceat(inside, line_start, dtype=np.int64) > 0 if len(line_start) else np.zeros(0, bool)  # a line's bytes up to the next line's
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    line_hash = span_hashes(b.buf, line_start, line_end)
    order = np.lexsort((np.arange(len(line_hash)), line_hash, line_doc))
    again = (line_hash[order][1:] == line_hash[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = per(line_doc[order][1:][again])

    key, same = windows(hashes, docs, 3)
    at = np.flatnonzero(same)
    order = at[np.lexsort((key[at], docs[at]))]
    again = (key[order][1:] == key[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= again
    twice[:-1] |= again
    cover = np.zeros(len(docs) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + 3, -1)
    repeat = per(docs[np.cumsum(cover[:-1]) > 0])
    return n_words, chars, symbols, dup_lines, repeat, (starts, ends, docs, hashes)


class Encoder:
    """Tokens of a batch of words by a sentencepiece model or a file of byte-pair ranks; is_byte marks the byte tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
            self.encode = lambda words: sp.encode(words, num_threads=1)
        else:
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[r for t, r in ranks.items() if len(t) == 1 and t[0] >= 0x80]] = True
            bpe = tiktoken.Encoding("words", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [bpe.encode_ordinary(" " + w) for w in words]


class Fertility:
    """Token counts of words by one vocabulary, remembered by the word's hash."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.is_byte = self.encoder.is_byte
        self.clear()

    def clear(self) -> None:
        self.keys, self.ids, self.flat, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new words, given with their hashes."""
        got = self.encoder.encode([t[:LONG_WORD] for t in texts])
        for k, t in enumerate(texts):
            if len(t) > LONG_WORD:
                got[k] = list(chain(got[k], *self.encoder.encode([t[i : i + LONG_WORD] for i in range(LONG_WORD, len(t), LONG_WORD)])))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.at) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        keys, ids = np.concatenate([self.keys, hashes]), np.concatenate([self.ids, first + np.arange(len(got))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids[order]

    def figures(self, b: Block, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Tokens, byte tokens and token entropy of each document; words: np.unique of the words' hashes."""
        if len(self.keys) > MEMO_WORDS:
            self.clear()
        own, first, back = words
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        if not known.all():
            raw, new = b.buf.tobytes(), np.flatnonzero(~known)
            self.learn(own[new], [raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            at = np.searchsorted(self.keys, own)
        word = self.ids[at][back]
        size = (self.at[1:] - self.at[:-1])[word]
        token = self.flat[np.repeat(self.at[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        of = np.repeat(docs, size)
        many = np.bincount(of, minlength=b.n)
        byte = np.bincount(of, self.is_byte[token], b.n)
        pair, count = np.unique(of * np.int64(len(self.is_byte)) + token, return_counts=True)
        owner = pair // len(self.is_byte)
        entropy = np.log2(np.maximum(many, 1)) - np.bincount(owner, count * np.log2(count), b.n) / np.maximum(many, 1)
        return many, byte, np.maximum(entropy, 0)


def scripts(b: Block) -> np.ndarray:
    """The index in SCRIPTS of each document's most frequent letters, from the lead bytes of its characters."""
    lead, nxt = b.buf, np.r_[b.buf[1:], np.zeros(1, np.uint8)][: len(b.buf)]
    lower = lead | 0x20
    kinds = [
        ((lower >= 0x61) & (lower <= 0x7A)) | ((lead >= 0xC3) & (lead <= 0xC9)),
        (lead >= 0xD0) & (lead <= 0xD4),
        (lead == 0xCE) | (lead == 0xCF),
        (lead >= 0xE3) & (lead <= 0xED) & (nxt >= 0x80),
        (lead >= 0xD5) & (lead <= 0xE2) & (nxt >= 0x80),
    ]
    counts = np.stack([b.sums(k) for k in kinds])
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), SCRIPTS.index("other"))


def memos(*paths: str) -> tuple[Fertility, ...]:
    return tuple(map(Fertility, paths))


def figures_array(texts: pa.Array, paths: tuple[str, ...]) -> pa.Array:
    own = kept_model(memos, *paths)
    cols: list[list] = [[] for _ in range(8)]
    fert: list[list] = [[], [], []]  # a row per document, a number per vocabulary
    some_parts = []
    for b in blocks(texts, lower=False):
        n_words, chars, symbols, dup, repeat, (starts, ends, docs, hashes) = base_counts(b)
        none = np.zeros(b.n)
        words = np.unique(hashes, return_index=True, return_inverse=True)
        got = [m.figures(b, starts, ends, docs, words) if len(starts) else (none, none, none) for m in own]
        many = got[0][0]
        size_class = np.floor(CLASSES * np.log2(np.maximum(many, 1))).astype(np.int32)
        failed = (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)
        for col, x in zip(cols, (n_words, chars, symbols, dup, repeat, failed, np.array(SCRIPTS)[scripts(b)], size_class), strict=True):
            col.append(x)
        fert[0].append(np.stack([chars / np.maximum(m, 1) for m, _, _ in got], axis=1))
        fert[1].append(np.stack([n / np.maximum(m, 1) for m, n, _ in got], axis=1))
        fert[2].append(np.stack([e for _, _, e in got], axis=1))
        some_parts.append(n_words > 0)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int32()]
    arrays = [pa.array(np.concatenate(x).tolist() if x else [], k) for x, k in zip(cols, kinds, strict=True)]
    some = np.concatenate(some_parts) if some_parts else np.zeros(0, bool)
    for x in fert:
        rows = np.concatenate(x).tolist() if x else []
        arrays.append(pa.array([r if s else None for r, s in zip(rows, some.tolist(), strict=True)], pa.list_(pa.float64())))
    return pa.StructArray.from_arrays(arrays, names=[x.split(":")[0] for x in FIGURES[7:-1].split(",")])


def figures(text: Column, paths: tuple[str, ...]) -> Column:
    """A struct (FIGURES) of base counts and, per vocabulary, fertility figures of each text."""
    return once(F.arrow_udf(lambda texts: figures_array(texts, paths), FIGURES))(text.cast("string"))


@dataclass(frozen=True)
class Bands:
    """(group, size class, figure, vocabulary) -> the values between which texts are kept."""

    of: dict[tuple[str, int, int, int], tuple[float, float]]

    def table(self, spark) -> DataFrame:  # noqa: ANN001
        rows = {}
        for (group, size, figure, vocabulary), band in self.of.items():
            rows.setdefault((group, size), {})[figure, vocabulary] = band
        lists = [(g, s, *[[[own.get((f, v), LIMITS[f])[k] for v in range(len(VOCABULARIES))] for k in (0, 1)] for f in range(3)]) for (g, s), own in rows.items()]
        return spark.createDataFrame(lists, "g string, s int, chars array<array<double>>, bytes array<array<double>>, entropy array<array<double>>")


def band_of(counts: dict[int, int], figure: int) -> tuple[float, float]:
    """The band of a histogram bin -> rows of one figure."""
    bins = np.array(sorted(counts))
    rows = np.cumsum([counts[b] for b in bins.tolist()])
    q1, q2, q3 = (float(bins[np.searchsorted(rows, q * rows[-1])] + 0.5) / BINS[figure] for q in (0.25, 0.5, 0.75))
    below = above = max(FENCE * max(q2 - q1, q3 - q2) / 0.6745, SLACK[figure])
    if figure == 2:  # junk repeats itself: it pulls the lower quartile of entropy down, while many words at once are no fault
        below = max(FENCE * (q3 - q2) / 0.6745, SLACK[figure])
        above = 2 * below
    low, high = LIMITS[figure]
    return max(low, q2 - below), min(high, q2 + above)


def fit(rows: DataFrame) -> Bands:
    """Bands of rows (lang, f: FIGURES): all that pass the base rules.

    What reaches the driver is a histogram: groups x size classes x figures x bins
    of fixed width, a few thousand numbers, however many the documents are.
    Languages with fewer than MIN_ROWS rows are left to their scripts before.
    """
    good = rows.where(~F.col("f.base_failed"))
    entries = [F.struct(F.lit(figure).alias("figure"), F.lit(v).alias("v"), F.floor(F.col(f"f.{name}")[v] * BINS[figure]).cast("int").alias("bin")) for figure, name in enumerate(("chars_per_token", "byte_share", "token_entropy")) for v in range(len(VOCABULARIES))]
    flat = good.select("lang", F.col("f.script").alias("script"), F.col("f.size_class").alias("s"), F.explode(F.array(*entries)).alias("e"))
    counts = cut(flat.groupBy("lang", "script", "s", "e.figure", "e.v", "e.bin").agg(F.count("*").alias("n")))
    known = counts.where("lang IS NOT NULL AND figure = 0 AND v = 0").groupBy("lang").agg(F.sum("n").alias("m")).where(F.col("m") >= MIN_ROWS).select("lang")
    by_lang = counts.join(known, "lang").select(F.concat(F.lit("lang:"), "lang").alias("g"), "s", "figure", "v", "bin", "n")
    by_script = counts.select(F.concat(F.lit("script:"), "script").alias("g"), "s", "figure", "v", "bin", "n")
    grouped: dict = {}
    for g, s, figure, v, b, n in by_lang.union(by_script).groupBy("g", "s", "figure", "v", "bin").agg(F.sum("n").alias("n")).collect():
        grouped.setdefault((g, figure, v), {}).setdefault(s, {})[b] = n
    out = {}
    for (g, figure, v), classes in grouped.items():
        for s in range(min(classes), max(classes) + 1):
            for reach in range(max(classes) - min(classes) + 1):
                own: dict[int, int] = {}
                for t in range(s - reach, s + reach + 1):
                    for b, n in classes.get(t, {}).items():
                        own[b] = own.get(b, 0) + n
                if sum(own.values()) >= MIN_ROWS:
                    out[g, s, figure, v] = band_of(own, figure)
                    break
    return Bands(out)


def judge(df: DataFrame, f: str, lang: str | None, bands: Bands, out: str) -> DataFrame:
    """df with the boolean column out: whether the text that the struct f describes is kept."""
    t = bands.table(df.sparkSession)
    a, z = (fresh(df, n) for n in ("band_lang", "band_script"))
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), value, F.lit("/"), F.col(f"{f}.size_class"))
    keys = {a: key("lang", F.col(lang).cast("string")) if lang else F.lit(None).cast("string"), z: key("script", F.col(f"{f}.script"))}
    joined = df
    for name, value in keys.items():
        k = fresh(joined, f"{name}_key")
        # one row for a group and size class that has MIN_ROWS rows near: a bounded table
        joined = joined.join(F.broadcast(t.select(F.concat("g", F.lit("/"), "s").alias(k), F.struct("chars", "bytes", "entropy").alias(name))), value == F.col(k), "left").drop(k)
    band = F.coalesce(F.col(a), F.col(z))
    ok = ~F.col(f"{f}.base_failed") & F.col(f"{f}.token_entropy").isNotNull()
    for figure, (name, part) in enumerate((("chars_per_token", "chars"), ("byte_share", "bytes"), ("token_entropy", "entropy"))):
        for v in range(len(VOCABULARIES)):
            low, high = (F.coalesce(band[part][k][v], F.lit(LIMITS[figure][k])) for k in (0, 1))
            ok &= F.col(f"{f}.{name}")[v].between(low, high)
    return joined.withColumn(out, F.coalesce(ok, F.lit(False))).drop(a, z)


def query(docs: DataFrame) -> DataFrame:
    """op9: doc_id, base counts, verdict and figures of every document."""
    rows = cut(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), figures(F.col("text"), vocabularies(docs)).alias("f")))
    return judge(rows, "f", "lang", fit(rows), "kept").select("doc_id", "f.*", "kept")


def vocabularies(df: DataFrame) -> tuple[str, ...]:
    return tuple(tokenizer_path(df.sparkSession, name) for name in VOCABULARIES)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with their columns.

    Texts are read and assessed twice, for the bands and for the verdict: so
    nothing but a histogram is stored between.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    paths = vocabularies(docs)
    bands = fit(docs.select(lang.alias("lang"), figures(F.col(text_col), paths).alias("f")))
    f = fresh(docs, "figures")
    marked = docs.withColumn(f, figures(F.col(text_col), paths))
    verdict = fresh(marked, "verdict")
    return judge(marked, f, lang_col, bands, verdict).where(F.col(verdict)).select(*docs.columns)


def entropy_of(counts: list[int]) -> float:
    """Entropy in bits of a histogram; the plain form of what figures() computes."""
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c)
