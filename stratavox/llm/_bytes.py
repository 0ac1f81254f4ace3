"""Vectorised tokenising over the UTF-8 bytes of Arrow string columns.

Texts are never turned into Python strings here: an Arrow string array is one
byte buffer with offsets, and words, their hashes and n-gram keys are computed
over blocks of that buffer with numpy.

Memory. Short texts are taken in blocks of BLOCK_BYTES; a longer text is a block
of its own. Per byte of a block only flags of one byte are alive; what needs 64
bits a byte (hashing) runs over steps of STEP bytes, so a long text costs a few
bytes a byte and a few numbers of 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text worked on at once, and bytes of it that are hashed at once.
BLOCK_BYTES, STEP = 1 << 20, 1 << 18

_WORD = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_TOKEN = np.ones(256, bool)  # [^\x20\x09-\x0D]
_TOKEN[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Documents first..first+n-1 of an array; offs has n + 1 entries into buf."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the maximal runs where inside holds; no run crosses documents."""
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offs] = True
        before = np.empty(len(inside), bool)
        before[:1], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(inside), bool)
        after[-1:], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offs, starts, side="right") - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        out = np.zeros(self.n, np.int64)
        some = np.flatnonzero(np.diff(self.offs))
        if len(some):
            out[some] = np.add.reduceat(flags, self.offs[some], dtype=np.int64)
        return out


def blocks(texts: pa.Array, lower: bool, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts of about `most` bytes; a longer text is a block of its own. Null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        buf = data[offs[at] : offs[to]]
        yield Block(at, _LOWER[buf] if lower else buf, (offs[at : to + 1] - offs[at]).astype(np.int64))
        at = to


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphanumeric or non-ASCII words of a lower-cased block."""
    return block.spans(_WORD[block.buf])


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space."""
    return block.spans(_TOKEN[block.buf])


_MASK = (1 << 64) - 1
_INVERSE = pow(int(_BASE), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(int(_BASE), STEP), _powers(_INVERSE, STEP)


def in_token(block: Block) -> np.ndarray:
    """Which bytes of a block belong to words between ASCII white space."""
    return _TOKEN[block.buf]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each non-empty run of values, or of of[values]; starts and ends are in order.

    The hash is a polynomial of the values, taken as the difference of two prefix
    sums, scaled back to the run's start.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    before, until, scale = (np.empty(len(starts), np.uint64) for _ in range(3))
    carry, up, down = 0, 1, 1  # the prefix sum and the powers at the step's start
    for lo in range(0, int(ends[-1]), STEP):
        part = values[lo : lo + STEP] if of is None else of[values[lo : lo + STEP]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * _UP[: len(part)], dtype=np.uint64, out=sums[1:])
        sums = sums * np.uint64(up) + np.uint64(carry)
        for places, out in ((starts, before), (ends, until)):
            own = slice(*np.searchsorted(places, (lo, lo + len(part) + (lo + STEP >= len(values)))))
            out[own] = sums[places[own] - lo]
            if places is starts:
                scale[own] = _DOWN[np.minimum(places[own] - lo, STEP - 1)] * np.uint64(down)
        carry = int(sums[-1])
        up, down = up * pow(int(_BASE), STEP, 1 << 64) & _MASK, down * pow(_INVERSE, STEP, 1 << 64) & _MASK
    if ends[-1] % STEP == 0:  # the last span ends where a step would begin
        last = np.searchsorted(ends, ends[-1])
        until[last:] = np.uint64(carry)
    return mix((until - before) * scale + (ends - starts).astype(np.uint64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """run_hashes() of bytes."""
    return run_hashes(buf, starts, ends, _BYTE)


def windows(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and which of them lie in one document."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key = hashes[:count].copy()
    for k in range(1, n):
        key = key * _BASE + hashes[k : k + count]
    return mix(key), docs[:count] == docs[n - 1 :]
