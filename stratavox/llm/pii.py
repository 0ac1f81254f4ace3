r"""Personal data and information-theoretic sanitisation (operator 10).

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers; each distinct value is a protected entity, and so is its group (mail
domain, first three parts of an address, first digits of a number), so that values
that occur once have evidence too. Terms (runs of letters) within CONTEXT words of
an entity may disclose it although they are no personal data themselves. Of n(t)
occurrences of a term in the corpus of N, j(e, t) lie near e, in m(e, t) differing
contexts (a copied passage is one context, however often it was copied); with s(e)
context places of e

    PMI(e; t) = log2(q N / s),  bits left = log2(N / s) - PMI(e; t) = -log2 q

where q is the lower bound (Wilson, z = Z) of the share j / n as m of m n / j trials
show it, so that a term needs the more support the less exclusive it is, and one
context never suffices. Neither do m contexts that chance explains: m log2(N / s) bits
must exceed log2 of the number of terms, which were all tried, by CHANCE. A term that leaves GENERALISE bits or less (q of a half or
more), and tells one bit at least, discloses the entity: all its occurrences in all
texts, as the entity is masked in all of them, are generalised, or removed if it
leaves REMOVE bits or less. The bits left are reported.

Scale. Contexts grow with entity occurrences, not with pairs of anything; pair
and term counts are pre-aggregated. Disclosing terms are broadcast up to MOST_TERMS
and marked as texts are read; beyond, they are joined with the terms of every text.

Defined cases: a null text is empty and has no spans; patterns that the checks
fail (an IP part over 255, a card without Luhn sum) are dropped; repeated rows and
ties are each returned and counted; a very long text is one block of a few numbers
a word; an empty table gives no rows; null ids and extra columns, clashing names
too, are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import Block, blocks, mix, span_hashes
from ._common import cut, fresh

CONTEXT, Z, CHANCE, GENERALISE, REMOVE = 8, 1.28, 7.0, 1.0, 0.25
#: Disclosing terms are broadcast up to so many (9 MB); beyond, they are joined with the terms of every text.
MOST_TERMS = 1_000_000
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole or not at all, so that long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = np.zeros(256, bool)
_TERM[0x61:0x7B] = _TERM[0x80:] = True
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_TERM_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])
_MARKS = "array<struct<start:int,end:int,bits:double>>"
_CTX = pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])
_SCAN = "struct<base:array<struct<kind:int,start:int,end:int>>,ctx:array<struct<e:bigint,t:bigint,c:bigint>>>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ outwards: linear in the text."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            end = m.end()
            out.append((s, end))
        p = text.find("@", max(end, p + 1))
    return out


def luhn(digits: str) -> bool:
    own = [int(x) for x in reversed(digits)]
    return sum(own[::2] + [2 * x - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, normalised value) of the base patterns, by kind and start; code points."""
    out = [(0, s, e, text[s:e].lower()) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            out.append((1, *m.span(), m[0]))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span(), digits))
    for m in _PHONE.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 8 <= len(digits) <= 15:
            out.append((3, *m.span(), digits))
    return out


def _signed(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode(), digest_size=8).digest(), "little", signed=True)


def terms(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.spans(_TERM[b.buf])


def group_of(kind: int, value: str) -> str:
    """What values of one holder have in common: the domain, the first three parts of an address, the first digits."""
    return (value.rpartition("@")[2], value.rpartition(".")[0], value[:6], value[:6])[kind]


def _contexts(raw: bytes, text: str, spans: list, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> list[dict]:
    """What stands near each entity; starts and ends are byte places of the document's terms."""
    ascii_only = len(raw) == len(text)
    point = None if ascii_only else np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    first, last = (starts, ends) if ascii_only else (point[starts], point[ends])
    free = np.ones(len(starts), bool)
    for _, s, e, _ in spans:
        free[np.searchsorted(last, s, side="right") : np.searchsorted(first, e, side="left")] = False
    first, keys = first[free], keys[free]
    out = []
    for kind, s, _, value in spans:
        k = int(np.searchsorted(first, s))
        own = slice(max(0, k - CONTEXT), k + CONTEXT)
        near = keys[own]
        if not len(near):
            continue
        c = int(mix(np.array([np.bitwise_xor.reduce(mix(near + np.arange(len(near), dtype=np.uint64)))])).view(np.int64)[0])
        for e in (_signed(f"{kind}:{value}"), _signed(f"{kind}/{group_of(kind, value)}")):
            out += [{"e": e, "t": t, "c": c} for t in near.view(np.int64).tolist()]
    return out


def scan_array(texts: pa.Array) -> pa.Array:
    base, ctx = [], []
    for b in blocks(texts, lower=True):
        hot = np.isin(b.buf, np.frombuffer(b"@0123456789", np.uint8))  # no base pattern does without
        likely = b.sums(hot) > 0
        found: dict[int, tuple] = {}
        for d in np.flatnonzero(likely).tolist():
            raw = b.buf[b.offs[d] : b.offs[d + 1]].tobytes()
            text = raw.decode()
            if spans := base_spans(text):
                found[d] = raw, text, spans
        if found:
            starts, ends, docs = terms(b)
            keys, bounds = span_hashes(b.buf, starts, ends), np.searchsorted(docs, np.arange(b.n + 1))
        for d in range(b.n):
            if d not in found:
                base.append([])
                ctx.append([])
                continue
            own = slice(bounds[d], bounds[d + 1])
            base.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in found[d][2]])
            ctx.append(_contexts(*found[d], starts[own] - b.offs[d], ends[own] - b.offs[d], keys[own]))
    return pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(ctx, pa.list_(_CTX))], names=["base", "ctx"])


def scan(text: Column) -> Column:
    return F.arrow_udf(scan_array, _SCAN)(text.cast("string"))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, n): occurrences of every term in all texts; a task sends each of its terms once or a few times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        def flush() -> pa.RecordBatch:
            own, back = np.unique(np.concatenate(keys), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(back, np.concatenate(counts)).astype(np.int64))], names=["t", "n"])
        for batch in batches:
            for b in blocks(batch.column(0), lower=True):
                starts, ends, _ = terms(b)
                own, n = np.unique(span_hashes(b.buf, starts, ends), return_counts=True)
                keys.append(own)
                counts.append(n)
                held += len(own)
                if held > 2_000_000:
                    yield flush()
                    keys, counts, held = [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "t bigint, n bigint")
    return rows.groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(contexts: DataFrame, counts: DataFrame) -> DataFrame:
    """(e, t, bits) of the terms that disclose an entity, from contexts (e, t, c) and written corpus counts (t, n)."""
    pairs = cut(contexts.groupBy("e", "t", "c").agg(F.count("*").alias("j")).groupBy("e", "t").agg(F.sum("j").alias("j"), F.count("*").alias("m")))
    places = pairs.groupBy("e").agg(F.sum("j").alias("s"))
    size = counts.agg(F.sum("n"), F.count("*")).first()
    total = F.lit(float(size[0] or 0))
    known = pairs.where("m > 1").join(counts, "t").join(places, "e").where(F.col("m") * F.log2(total / F.col("s")) >= CHANCE + math.log2(max(size[1], 1)))
    share = F.least(F.lit(1.0), F.col("j") / F.col("n"))
    trials = F.col("m") / share
    q = (share + Z * Z / (2 * trials) - Z * F.sqrt(share * (1 - share) / trials + Z * Z / (4 * trials * trials))) / (1 + Z * Z / trials)
    told = known.select("e", "t", F.col("s"), q.alias("q")).where(F.col("q") * total >= 2 * F.col("s"))
    return told.select("e", "t", (-F.log2("q")).alias("bits")).where(F.col("bits") <= GENERALISE)


def mark_array(texts: pa.Array, keys: np.ndarray, bits: np.ndarray) -> pa.Array:
    """Every place of the sorted terms in each text outside its base matches; code points."""
    out: list = []
    for b in blocks(texts, lower=True):
        starts, ends, docs = terms(b)
        hashes = span_hashes(b.buf, starts, ends)
        at = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
        hits = np.flatnonzero(keys[at] == hashes) if len(keys) else np.zeros(0, int)
        bounds = np.searchsorted(docs[hits], np.arange(b.n + 1))
        for d in range(b.n):
            own = hits[bounds[d] : bounds[d + 1]]
            if not len(own):
                out.append([])
                continue
            raw = b.buf[b.offs[d] : b.offs[d + 1]]
            point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            first, last = point[starts[own] - b.offs[d]], point[ends[own] - b.offs[d]]
            free = np.ones(len(own), bool)
            for _, s, e, _ in base_spans(raw.tobytes().decode()):
                free[np.searchsorted(last, s, side="right") : np.searchsorted(first, e, side="left")] = False
            out.append([{"start": s, "end": e, "bits": x} for s, e, x in zip(first[free].tolist(), last[free].tolist(), bits[at[own]][free].tolist(), strict=True)])
    return pa.array(out, pa.list_(_TERM_SPAN))


def text_terms(texts: pa.Array) -> pa.Array:
    """The distinct terms of each text."""
    out = []
    for b in blocks(texts, lower=True):
        starts, ends, docs = terms(b)
        keys, bounds = span_hashes(b.buf, starts, ends).view(np.int64), np.searchsorted(docs, np.arange(b.n + 1))
        out += [np.unique(keys[bounds[d] : bounds[d + 1]]) for d in range(b.n)]
    return pa.array(out, pa.list_(pa.int64()))


def mark_terms(docs: DataFrame, text_col: str, out: str, clean: Callable[[pa.Array, pa.Array], pa.Array] | None = None) -> DataFrame:
    """docs with the column out: the spans of disclosing terms in each text, and the bits that each leaves; or clean(texts, spans), strings, by the same worker."""
    text = F.col(text_col).cast("string")
    contexts = cut(docs.select(F.explode(scan(text)["ctx"]).alias("x")).select("x.e", "x.t", "x.c"))
    bad = disclosing(contexts, cut(term_counts(docs, text_col)))
    bad = cut(bad.groupBy("t").agg(F.min("bits").alias("bits")))
    if bad.count() <= MOST_TERMS:
        rows = bad.collect()
        keys, bits = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], float)
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], bits[order]))
        if clean:
            return docs.withColumn(out, F.arrow_udf(lambda t: clean(t, mark_array(t, *shared.value)), "string")(text))
        return docs.withColumn(out, F.arrow_udf(lambda t: mark_array(t, *shared.value), _MARKS)(text))
    texts = docs.select(_digest(text).alias("th"), text.alias("text")).dropDuplicates(["th"])
    own = texts.select("th", F.explode(F.arrow_udf(text_terms, "array<bigint>")("text")).alias("t")).join(bad, "t")
    lists = own.groupBy("th").agg(F.collect_list(F.struct("t", "bits")).alias("l"))  # a text's terms

    def mark(t: pa.Array, keys: pa.Array, bits: pa.Array) -> pa.Array:
        own, first = np.unique(np.asarray(keys.flatten()).view(np.uint64), return_index=True)  # a batch's terms disclose in all its texts
        return mark_array(t, own, np.asarray(bits.flatten(), float)[first])

    found = cut(texts.join(lists, "th").select("th", F.arrow_udf(mark, _MARKS)("text", F.col("l.t"), F.col("l.bits")).alias(out)))
    digest = fresh(docs, "text_digest")
    joined = docs.withColumn(digest, _digest(text)).join(found.withColumnRenamed("th", digest), digest, "left")
    marks = F.coalesce(out, F.array().cast(_MARKS))
    return joined.select(*docs.columns, (F.arrow_udf(clean, "string")(text, marks) if clean else marks).alias(out))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _joined(spans: Column, names: Column | None = None) -> Column:
    label = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1) if names is None else names
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", label(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """op10: counts of base matches, their digest, all spans and the bits that the terms among them leave, of every document."""
    rows = mark_terms(docs.select("doc_id", "text"), "text", "terms").select("doc_id", scan(F.col("text"))["base"].alias("base"), "terms")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    every = F.array_join(F.filter(F.array(_joined(F.col("base")), _joined(F.col("terms"), F.lit("term"))), lambda x: x != ""), ",")
    return rows.select("doc_id", *map(count, range(4)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("bigint").alias("n_terms"), F.transform("terms", lambda x: F.round(x["bits"], 4)).alias("term_bits"))


def clean_text(text: str, spans: list[tuple[int, int, int, str]], extra: list[dict]) -> str:
    """text with base matches and generalised terms replaced by their kind and removed terms left out."""
    cuts = sorted([(s, e, f"[{KINDS[k].upper()}]") for k, s, e, _ in spans] + [(x["start"], x["end"], "" if x["bits"] <= REMOVE else "[TERM]") for x in extra])
    out, at = [], 0
    for s, e, label in cuts:
        if s >= at:
            out += [text[at:s], label]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with sanitised texts; same rows and columns."""
    cleaned = fresh(docs, "clean_text")

    def clean(texts: pa.Array, extra: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), extra.to_pylist(), strict=True):
            got = base_spans(t) if t and ("@" in t or "+" in t or re.search("[0-9]", t)) else []
            out.append(clean_text(t, got, own or []) if got or own else t)
        return pa.array(out, pa.string())

    return mark_terms(docs, text_col, cleaned, clean).withColumn(text_col, F.col(cleaned)).select(*docs.columns)
