r"""SentencePiece encoding, decoding and sampling without replacement (operator 8).

Encoding and decoding use a public model. Sampling draws SAMPLES distinct
segmentations of a text by Gumbel top-k: every segmentation carries its
log-probability plus Gumbel noise, and the largest are emitted in order by an
A* search whose node priorities are exact maxima of perturbed log-probabilities.

Lattice. Edges are the vocabulary's pieces, weighted 1 / (RANK_SHIFT + rank); a
character outside the vocabulary is one edge of its UTF-8 byte pieces. Spaces
are U+2581 as in the model, and a literal U+2581 is spelled in bytes, so that
decoding gives the text back. Where no piece spans two neighbouring characters
the lattice falls apart, and a text is a sequence of independent segments.
Backward sums over a block's distinct segments are computed at once.

Search. A node is a prefix of decided segments. The best leaf below a node is
drawn segment by segment; what branches off it at a segment is one sibling
node, whose maximum is a Gumbel variable at the log of its mass, truncated at
the leaf's value. The sibling with the largest maximum is opened next: its
segment is drawn from what is left (excluded segmentations form a trie), the
rest freely. So each further sample costs one pass over the text, and the next
sibling's maximum is the threshold kappa that gives inclusion probabilities
1 - exp(-exp(log p - kappa)). Those of long texts are too small for a number, so
that their logarithms are returned beside them: weights are exp(-log_inclusion)
relative to one another.

Randomness is a hash of row key, sample, segment and step: a row's samples do
not depend on partitions, batches or retries.

Defined cases: a null or empty text has one segmentation, without pieces, of
log-probability 0 and inclusion 1; texts with fewer segmentations than asked
for give all of them (whether others exist is told by the lattice, not by their
mass); a null row key is key 0; rows of one key and text have the same samples; a
very long text is one block, of about 300 bytes a character; an empty table gives
no rows; columns are passed by value, so extra ones can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ._bytes import Block, blocks, mix, run_hashes
from ._common import kept_model, tokenizer_path

MODEL = "piece_bpe_32k.model"
SAMPLES, RANK_SHIFT, SEED = 3, 2.0, 42
#: Characters of the segments that a worker remembers before it starts anew: about 20 MB of lattice.
KNOWN_CHARS = 200_000
_SPACE, _ESCAPED = 0x2581, 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Multiplier of a generator whose upper bits are used: one multiplication a step.
_STEP = np.uint64(6364136223846793005)
#: What a draw leaves of a segment with other segmentations, if that is below a double's resolution.
_LEAST = 2.0**-56
_ALL = (1 << 64) - 1
_TYPE = "array<struct<ids:array<int>,log_prob:double,gumbel:double,inclusion:double,log_inclusion:double>>"


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform_int(x: int) -> float:
    """_uniform() of one key."""
    x &= _ALL
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _ALL
    return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)


class Vocabulary:
    """Pieces of a sentencepiece model: hashes, weights, and the pairs of characters that some piece spans."""

    def __init__(self, model: str):
        import sentencepiece

        self.known = Known()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        ids, chars = [], []
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                ids.append(i)
                chars.append(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
                self.raw[i] = piece.replace("▁", " ").encode()
        size = np.array([len(c) for c in chars])
        self.longest = int(size.max())
        # ranks follow the ids: a BPE model's merges are learned in that order, its single characters last
        weight = -np.log(RANK_SHIFT + np.arange(len(ids), dtype=np.float64))
        total = np.log(np.exp(weight).sum() + 1)
        self.byte_weight = -np.log(RANK_SHIFT + len(ids)) - total
        key, prefixes = self._hashes(chars, size)
        order = np.argsort(key)
        self.key, self.id, self.weight = key[order], np.array(ids, np.int32)[order], (weight - total)[order]
        # place in `key` of the first key with given top bits, counted from 1: 22 bits, then a step or two for crowded ones
        self.table_bits = 22
        top = self.key >> np.uint64(64 - self.table_bits)
        self.table = np.zeros(1 << self.table_bits, np.int32)
        self.table[top[::-1]] = np.arange(len(top), 0, -1)
        self.crowded = int(np.unique(top, return_counts=True)[1].max()) - 1
        self.prefix = np.zeros(1 << 22, bool)
        self.prefix[prefixes >> np.uint64(42)] = True
        flat = np.unique(np.concatenate([c for c in chars if len(c) > 1] or [np.zeros(0, np.uint32)]))
        self.kind = np.zeros(0x110001, np.int16)
        self.kind[flat] = np.arange(1, len(flat) + 1)
        self.pair = np.zeros((len(flat) + 1, len(flat) + 1), bool)
        for c in chars:
            self.pair[self.kind[c[:-1]], self.kind[c[1:]]] = True

    @staticmethod
    def _hashes(chars: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces, and of all their prefixes."""
        flat, start = mix(np.concatenate(chars).astype(np.uint64) + np.uint64(1)), np.cumsum(size) - size
        h, key, prefixes = np.zeros(len(chars), np.uint64), np.zeros(len(chars), np.uint64), []
        for n in range(int(size.max())):
            own = np.flatnonzero(size > n)
            h[own] = h[own] * _BASE + flat[start[own] + n]
            key[own] = mix(h[own])
            prefixes.append(key[own])
        return key, np.concatenate(prefixes)


@dataclass
class Lattice:
    """The distinct segments of a block, laid end to end, with the edges that leave each place.

    Edges first[p] to first[p + 1] leave place p, by size: edge is a piece's id, or -2 for the bytes of the character;
    it takes size characters with the conditional log-probability log_cond. below sums the probabilities of a place's
    edges up to this one, and is infinite at the last.
    """

    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    edge: np.ndarray
    size: np.ndarray
    log_cond: np.ndarray
    below: np.ndarray


def _edges(v: Vocabulary, chars: np.ndarray, last: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, sizes, ids and weights of all edges, in order of place and size; last: the end of each place's segment."""
    n = len(chars)
    code, h, alive = mix(chars.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64), np.arange(n)
    found, bare = [], np.ones(n, bool)
    for size in range(1, widest + 1):
        alive = alive[alive + size <= last[alive]]
        h[alive] = h[alive] * _BASE + code[alive + size - 1]
        key = mix(h[alive])
        ok = v.prefix[key >> np.uint64(42)]
        alive, key = alive[ok], key[ok]
        if not len(alive):
            break
        slot = v.table[key >> np.uint64(64 - v.table_bits)]
        hit = slot > 0
        for _ in range(v.crowded):  # keys that share their top bits follow each other
            step = np.flatnonzero(hit)
            step = step[(v.key[slot[step] - 1] < key[step]) & (slot[step] < len(v.key))]
            slot[step] += 1
        hit[hit] = v.key[slot[hit] - 1] == key[hit]
        at = alive[hit]
        if size == 1:
            bare[at] = False
        found.append((at, np.full(len(at), size, np.int64), v.id[slot[hit] - 1], v.weight[slot[hit] - 1]))
    alone = np.flatnonzero(bare)
    found.insert(0, (alone, np.ones(len(alone), np.int64), np.full(len(alone), -2, np.int32), v.byte_weight * _utf8_size(chars[alone])))
    place, size, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], size[order], code[order], weight[order]


def lattice(v: Vocabulary, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lattice:
    """start, end: bounds of the segments, which cover chars in order."""
    n = len(chars)
    widest = max(1, min(v.longest, int((end - start).max()))) if n else 1
    place, own, code, value = _edges(v, chars, np.repeat(end, end - start), widest)
    leaving = np.r_[0, np.cumsum(np.bincount(place, minlength=n))]
    # backward sums, from the last characters of all segments to their first: edges in order of the distance to the end
    stop = np.repeat(end, end - start)
    left = stop - np.arange(n)
    order = np.argsort(left.astype(np.uint16 if n and left.max() < 1 << 16 else np.int64)[place], kind="stable")
    at, x_all = place[order], value[order]
    to = at + own[order]
    to[to == stop[at]] = n  # nothing follows
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if n else np.zeros(0, np.int64)
    head = np.r_[first, len(at)]
    bounds = np.searchsorted(left[at[first]], np.arange(1, int(left.max()) + 2)) if n else []
    beta, share = np.zeros(n + 1), np.empty(len(at))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        e = slice(head[i], head[j])
        group, count = first[i:j] - head[i], np.diff(head[i : j + 1])
        x = x_all[e] + beta[to[e]]
        top = np.maximum.reduceat(x, group)
        x -= np.repeat(top, count)
        mass = np.exp(x)
        total = np.add.reduceat(mass, group)
        log = np.log(total)
        x_all[e], share[e] = x - np.repeat(log, count), mass / np.repeat(total, count)
        beta[at[first[i:j]]] = top + log
    log_cond, below = np.empty(len(at)), np.empty(len(at))
    if n:
        run = np.cumsum(share)
        log_cond[order] = x_all
        below[order] = run - np.repeat(run[first] - share[first], np.diff(head))
        below[leaving[1:] - 1] = np.inf  # a draw ends at the last edge, whatever the rounding
    return Lattice(chars, start, end, leaving, code, own.astype(np.int8), log_cond, below)


class Known:
    """The segments that a worker has met, with their lattice: frequent ones are laid out once, not in every block."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.kinds, self.blocks, self.lat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def prune(self) -> None:
        """Keeps the segments that more than one block had; starts anew if those are most of them."""
        keep = self.blocks > 1
        lat, old = self.lat, np.flatnonzero(keep)
        size = (lat.end - lat.start)[old]
        if size.sum() > KNOWN_CHARS // 2:
            self.clear()
            return
        stop = np.cumsum(size)
        at = np.repeat(lat.start[old] - (stop - size), size) + np.arange(int(size.sum()))
        many = np.diff(lat.first)[at]
        first = np.r_[0, np.cumsum(many)]
        e = np.repeat(lat.first[at] - first[:-1], many) + np.arange(first[-1])
        self.lat = Lattice(lat.chars[at], stop - size, stop, first, lat.edge[e], lat.size[e], lat.log_cond[e], lat.below[e])
        own = keep[self.kinds]
        self.keys, self.kinds = self.keys[own], (np.cumsum(keep) - 1)[self.kinds[own]]
        self.blocks = np.ones(len(old), np.int64)

    def kinds_of(self, v: Vocabulary, hashes: np.ndarray, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[Lattice, np.ndarray]:
        """A lattice that holds all segments given, and each one's number in it."""
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.lat is not None and len(self.lat.chars) > KNOWN_CHARS:
            self.prune()
        at = np.searchsorted(self.keys, own)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == own[there]
        if not there.all() or self.lat is None:
            new = np.flatnonzero(~there)
            size = (end - start)[first[new]]
            stop = np.cumsum(size)
            flat = chars[np.repeat(start[first[new]] - (stop - size), size) + np.arange(int(size.sum()))]
            fresh = lattice(v, flat, stop - size, stop)
            n = 0 if self.lat is None else len(self.lat.start)
            self.lat = fresh if self.lat is None else _append(self.lat, fresh)
            keys, kinds = np.r_[self.keys, own[new]], np.r_[self.kinds, n + np.arange(len(new))]
            order = np.argsort(keys, kind="stable")
            self.keys, self.kinds, self.blocks = keys[order], kinds[order], np.r_[self.blocks, np.zeros(len(new), np.int64)]
            at = np.searchsorted(self.keys, own)
        self.blocks[self.kinds[at]] += 1
        return self.lat, self.kinds[at][back]


def _append(a: Lattice, b: Lattice) -> Lattice:
    """b behind a."""
    n = len(a.chars)
    both = (np.concatenate([getattr(x, f) for x in (a, b)]) for f in ("edge", "size", "log_cond", "below"))
    return Lattice(np.r_[a.chars, b.chars], np.r_[a.start, b.start + n], np.r_[a.end, b.end + n], np.r_[a.first, a.first[-1] + b.first[1:]], *both)


def _utf8_size(chars: np.ndarray) -> np.ndarray:
    c = np.where(chars == _ESCAPED, _SPACE, chars)
    return 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)


def cut_segments(v: Vocabulary, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's characters, and starts, ends and documents of its segments."""
    raw = b.buf.tobytes()
    chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).copy()
    point = np.r_[0, np.cumsum((b.buf & 0xC0) != 0x80)][b.offs]
    chars[chars == _SPACE] = _ESCAPED
    chars[chars == 0x20] = _SPACE
    kind = v.kind[chars]
    first = np.ones(len(chars), bool)
    first[1:] = ~v.pair[kind[:-1], kind[1:]]
    first[point[point < len(chars)]] = True
    start = np.flatnonzero(first)
    return chars, start, np.r_[start[1:], len(chars)].astype(np.int64) if len(start) else start, np.searchsorted(point, start, side="right") - 1


@dataclass
class Draw:
    """One sample of a block: pieces of each segment instance laid out by segment, and each segment's log-probability."""

    edge: np.ndarray  # edge codes, by instance and step
    at: np.ndarray  # place of each edge in the lattice
    slot: np.ndarray  # slot of each edge at its place
    bounds: np.ndarray  # of each instance's edges
    log_prob: np.ndarray


def draw(lat: Lattice, kind: np.ndarray, key: np.ndarray) -> Draw:
    """Free draws of the segment instances of the kinds given; key: an instance's random key."""
    n = len(kind)
    log_prob, count = np.zeros(n), np.zeros(n, np.int64)
    live, p, stop, state = np.arange(n), lat.start[kind], lat.end[kind], mix(key)
    steps = []
    while len(live):
        u = (state >> np.uint64(11)).astype(np.float64)
        u *= 1 / (1 << 53)
        base = lat.first[p]
        at = base.copy()
        more = np.flatnonzero(lat.below[at] <= u)
        while len(more):
            at[more] += 1
            more = more[lat.below[at[more]] <= u[more]]
        steps.append((live, p.astype(np.int32), lat.edge[at], (at - base).astype(np.int8)))
        log_prob[live] += lat.log_cond[at]
        count[live] += 1
        p = p + lat.size[at]
        on = np.flatnonzero(p < stop)
        live, p, stop, state = live[on], p[on], stop[on], state[on] * _STEP + _BASE
    bounds = np.r_[0, np.cumsum(count)]
    edge, at, slot = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.int8)
    for k, (own, place, code, choice) in enumerate(steps):
        to = bounds[own] + k
        edge[to], at[to], slot[to] = code, place, choice
    return Draw(edge, at, slot, bounds, np.minimum(log_prob, 0))


@dataclass
class Trie:
    """Excluded segmentations of a segment: the place of a node, and the share of its mass that they leave."""

    place: int
    children: dict[int, Trie] = field(default_factory=dict)
    left: float = 0.0


def _weights(lat: Lattice, node: Trie) -> list[float]:
    """The mass that each edge at a node has left."""
    first = int(lat.first[node.place])
    w = [exp(x) for x in lat.log_cond[first : int(lat.first[node.place + 1])].tolist()]
    for slot, child in node.children.items():
        w[slot] *= child.left
    return w


def excluding(lat: Lattice, kind: int, paths: list[tuple[int, ...]]) -> Trie:
    """The trie of paths (tuples of slots). What is left is added up from the ends, never subtracted: it is 0 only if no other path exists."""
    root = Trie(int(lat.start[kind]))
    levels = [[root]]
    for path in paths:
        node = root
        for depth, slot in enumerate(path, 1):
            if slot not in node.children:
                node.children[slot] = Trie(node.place + int(lat.size[int(lat.first[node.place]) + slot]))
                if depth == len(levels):
                    levels.append([])
                levels[depth].append(node.children[slot])
            node = node.children[slot]
    for nodes in reversed(levels):
        for node in nodes:
            if node.children:
                node.left = sum(_weights(lat, node))
    return root


def draw_other(lat: Lattice, kind: int, excluded: list[tuple[int, ...]], key: int) -> tuple[list[int], list[int], list[int], float]:
    """Edges, places, slots and log-probability of a draw that is none of `excluded` (tuples of slots); there must be one."""
    node, p, stop, step = excluding(lat, kind, excluded), int(lat.start[kind]), int(lat.end[kind]), 0
    edges, places, slots, log_prob = [], [], [], 0.0
    while p < stop:
        e = int(lat.first[p])
        logs = lat.log_cond[e : int(lat.first[p + 1])].tolist()
        w = _weights(lat, node) if node else [exp(x) for x in logs]
        left, slot = _uniform_int(key + step * 0x51ED2701 + 7) * sum(w), 0
        last = max(range(len(w)), key=lambda i: (w[i] > 0, i))  # noqa: B023
        while slot < last and (left >= w[slot] or not w[slot]):
            left -= w[slot]
            slot += 1
        edges.append(int(lat.edge[e + slot]))
        places.append(p)
        slots.append(slot)
        log_prob += logs[slot]
        node = node.children.get(slot) if node else None
        p, step = p + int(lat.size[e + slot]), step + 1
    return edges, places, slots, min(log_prob, 0.0)


def _replace(d: Draw, at: dict[int, tuple[list[int], list[int], list[int], float]]) -> Draw:
    """d with the draws of some instances put in."""
    count = np.diff(d.bounds)
    keep = np.ones(len(d.edge), bool)
    own = sorted(at)
    for i in own:
        keep[d.bounds[i] : d.bounds[i + 1]] = False
    new = count.copy()
    new[own] = [len(at[i][0]) for i in own]
    bounds = np.r_[0, np.cumsum(new)]
    edge, place, slot = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.int8)
    target = np.repeat(bounds[:-1] - d.bounds[:-1], count)[keep] + np.flatnonzero(keep)
    edge[target], place[target], slot[target] = d.edge[keep], d.at[keep], d.slot[keep]
    log_prob = d.log_prob.copy()
    if own:
        to = np.repeat(bounds[own] - (np.cumsum(new[own]) - new[own]), new[own]) + np.arange(int(new[own].sum()))
        edge[to], place[to], slot[to] = (np.concatenate([at[i][k] for i in own]) for k in range(3))
        log_prob[own] = [at[i][3] for i in own]
    return Draw(edge, place, slot, bounds, log_prob)


def _merge(a: Draw, b: Draw, from_b: np.ndarray) -> Draw:
    """Instances of b where from_b holds, of a elsewhere."""
    count = np.where(from_b, np.diff(b.bounds), np.diff(a.bounds))
    bounds = np.r_[0, np.cumsum(count)]
    source = np.where(from_b, b.bounds[:-1] + len(a.edge), a.bounds[:-1])
    at = np.repeat(source - bounds[:-1], count) + np.arange(bounds[-1])
    return Draw(np.concatenate([a.edge, b.edge])[at], np.concatenate([a.at, b.at])[at], np.concatenate([a.slot, b.slot])[at], bounds, np.where(from_b, b.log_prob, a.log_prob))


def _truncated(loc: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at loc, given that they are at most top."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(loc), -np.logaddexp(-top, np.log(-np.log(u)) - loc), -np.inf)


def sample_block(v: Vocabulary, b: Block, row_key: np.ndarray, samples: int) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """For each document the samples (ids, log-probability, perturbed value, log of inclusion), the largest value first."""
    chars, start, end, docs = cut_segments(v, b)
    bounds = np.searchsorted(docs, np.arange(b.n + 1))
    hashes = run_hashes(mix(chars.astype(np.uint64) + np.uint64(1)), start, end)
    lat, kind = v.known.kinds_of(v, hashes, chars, start, end)
    # every character is an edge, so a segment with as many edges as characters has one segmentation
    several = lat.first[lat.end[kind]] - lat.first[lat.start[kind]] > lat.end[kind] - lat.start[kind]
    n, doc_key = len(kind), mix(row_key + np.uint64(SEED))
    place = np.arange(n) - bounds[docs]
    order = lambda r, what: mix(doc_key[docs] + np.uint64((r * 8 + what) * 0x632BE5AB)) + place.astype(np.uint64) * _BASE

    def siblings(d: Draw, r: int, top: np.ndarray, since: np.ndarray, spent: dict[int, float]) -> np.ndarray:
        """Maxima of what branches off draw r of each document at its segments from `since` on."""
        before = np.cumsum(d.log_prob) - d.log_prob
        head = np.r_[before, 0.0][np.minimum(bounds[:-1], n)]
        before = before - head[docs]
        left = np.where(several, np.maximum(-np.expm1(d.log_prob), _LEAST), 0.0)
        for i, x in spent.items():
            left[i] = x
        with np.errstate(divide="ignore"):
            loc = before + np.log(left)
        value = _truncated(loc, top[docs], _uniform(order(r, 3)))
        value[place < since[docs]] = -np.inf
        return value

    top = -np.log(-np.log(_uniform(doc_key + np.uint64(11))))
    draws, values = [draw(lat, kind, order(0, 0))], [top]
    groups = [siblings(draws[0], 0, top, np.zeros(b.n, np.int64), {})]
    # by sample: what is taken at an instance, if more than its own
    excluded: list[dict[int, list[tuple[int, ...]]]] = [{}]
    per_doc = np.full((samples + 1, b.n), -np.inf)
    at_doc = np.zeros((samples + 1, b.n), np.int64)

    def best(r: int) -> None:
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            return
        per_doc[r, some] = np.maximum.reduceat(groups[r], bounds[some])
        hit = np.flatnonzero(groups[r] == per_doc[r][docs])
        at_doc[r, docs[hit[::-1]]] = hit[::-1]

    best(0)
    for r in range(1, samples):
        which, top = per_doc[:r].argmax(axis=0), per_doc[:r].max(axis=0)
        open_ = np.flatnonzero(np.isfinite(top))
        fresh, since, spent, own = draw(lat, kind, order(r, 0)), np.full(b.n, n + 1, np.int64), {}, {}
        merged, taken = draws[0], {}
        for s in range(1, r):  # the prefix comes from the sample that the sibling branches off
            merged = _merge(merged, draws[s], (which == s)[docs])
        for d in open_.tolist():
            s, i = int(which[d]), int(at_doc[which[d], d])
            since[d] = place[i]
            source = draws[s]
            paths = [*excluded[s].get(i, []), tuple(source.slot[source.bounds[i] : source.bounds[i + 1]].tolist())]
            got = draw_other(lat, int(kind[i]), paths, int(doc_key[d]) + r * 0x7F4A7C15 + int(place[i]) * 0x2545F491)
            own[i], taken[i], spent[i] = got, paths, excluding(lat, int(kind[i]), [*paths, tuple(got[2])]).left
            groups[s][i] = -np.inf
        for s in range(r):
            best(s)
        now = _replace(_merge(merged, fresh, place > since[docs]), own)
        draws.append(now)
        values.append(top)
        excluded.append(taken)
        groups.append(siblings(now, r, top, since, spent))
        best(r)
    kappa = per_doc[: len(draws)].max(axis=0)
    outs = [list(_ids(v, lat, d, bounds)) for d in draws]
    logs = [np.diff(np.r_[0, np.cumsum(d.log_prob)][bounds]) for d in draws]
    for d in range(b.n):
        rows = []
        for r in range(len(draws)):
            if np.isfinite(values[r][d]):
                lp = float(logs[r][d])
                rows.append((outs[r][d], lp, float(values[r][d]) + 0.0, log_inclusion(lp - float(kappa[d]))))
        yield rows


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), which is x where exp(x) is small: inclusion itself may be too small for a number."""
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def _ids(v: Vocabulary, lat: Lattice, d: Draw, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Piece ids of each document; byte edges become the ids of their bytes."""
    spelled = np.flatnonzero(d.edge == -2)
    ids, cuts = d.edge, d.bounds[bounds]
    if len(spelled):
        chars = lat.chars[d.at[spelled]]
        chars = np.where(chars == _ESCAPED, _SPACE, chars)
        size = np.ones(len(d.edge), np.int64)
        size[spelled] = _utf8_size(chars)
        to = np.r_[0, np.cumsum(size)]
        ids = np.repeat(d.edge, size)
        raw = np.frombuffer(chars.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(d.edge == -2, size)] = v.byte_id[raw]
        cuts = to[cuts]
    for i in range(len(cuts) - 1):
        yield ids[cuts[i] : cuts[i + 1]]


def vocabulary(model: str) -> Vocabulary:
    return kept_model(Vocabulary, model)


def sample_array(texts: pa.Array, keys: pa.Array, samples: int, model: str) -> pa.Array:
    v = vocabulary(model)
    row_key = np.array(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    ids, counts, logs, values, inclusion, many = [], [], [], [], [], []
    for b in blocks(texts, lower=False, most=1 << 19):
        for rows in sample_block(v, b, row_key[b.first : b.first + b.n], samples):
            many.append(len(rows))
            for own, lp, g, q in rows:
                ids.append(own)
                counts.append(len(own))
                logs.append(lp)
                values.append(g)
                inclusion.append(q)
    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat)
    struct = pa.StructArray.from_arrays([lists, pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(np.exp(inclusion), pa.float64()), pa.array(inclusion, pa.float64())], names=["ids", "log_prob", "gumbel", "inclusion", "log_inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), struct)


def model_path(spark: SparkSession) -> str:
    return tokenizer_path(spark, MODEL)


def sample(text: Column, key: Column, model: str, samples: int = SAMPLES) -> Column:
    """Distinct segmentations of each text, by falling perturbed value; key is the row's (any type)."""
    row = F.coalesce(F.xxhash64(key.cast("string")), F.lit(0))
    return F.arrow_udf(lambda t, k: sample_array(t, k, samples, model), _TYPE)(text.cast("string"), row)


def encode(text: Column, model: str) -> Column:
    """The model's own segmentation; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        sp = vocabulary(model).sp
        return pa.array([None if t is None else sp.encode(t, num_threads=1) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text.cast("string"))


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    return b"".join(map(v.raw.__getitem__, ids)).decode()


def spell(v: Vocabulary, ids: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and where each id's begin; `step` ids at a time."""
    sizes = np.fromiter(map(len, v.raw), np.int64, len(v.raw))
    table, own = np.frombuffer(b"".join(v.raw), np.uint8), np.cumsum(sizes) - sizes
    at = np.r_[0, np.cumsum(sizes[ids])]
    out = np.empty(at[-1], np.uint8)
    for s in range(0, len(ids), step):
        part, begin, end = ids[s : s + step], at[s], at[min(s + step, len(ids))]
        out[begin:end] = table[np.repeat(own[part] - at[s : s + len(part)], sizes[part]) + np.arange(begin, end)]
    return out, at


def decode(ids: Column, model: str) -> Column:
    """The text of sampled ids; null stays null."""

    def run(lists: pa.Array) -> pa.Array:
        v = vocabulary(model)
        return pa.array([None if x is None else decode_ids(v, x) for x in lists.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


def n_decoded(text: Column, drawn: Column, model: str) -> Column:
    """How many of the samples decode to the text (null is empty)."""

    def run(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        lists = drawn.flatten()
        spelled, at = spell(vocabulary(model), np.asarray(lists.flatten()))
        cuts = at[np.r_[0, np.asarray(lists.value_lengths()).cumsum()]].tolist()
        of, good = np.repeat(np.arange(len(texts)), np.asarray(drawn.value_lengths())), np.zeros(len(texts), np.int64)
        for i, start, end in zip(of.tolist(), cuts[:-1], cuts[1:], strict=True):
            good[i] += spelled[start:end].tobytes() == (texts[i].as_py() or "").encode()
        return pa.array(good)

    return F.arrow_udf(run, "bigint")(text.cast("string"), F.transform(drawn, lambda x: x["ids"]))
