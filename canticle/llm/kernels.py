"""Vectorised byte and word kernels that run inside Spark tasks on one Arrow batch at a time.

Texts arrive as one byte buffer plus offsets, so the work per byte is a few numpy passes and
memory is bounded by the batch.  Nothing here knows about Spark.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers of the polynomial hash and of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
FINAL_1 = 0xFF51AFD7ED558CCD
FINAL_2 = 0xC4CEB9FE1A85EC53
# The bytes that end a word, [\x20\x09-\x0D].
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes hashed at once; a word is never cut, so a longer word makes a longer piece.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(FINAL_1)
    x ^= x >> U(33)
    x *= U(FINAL_2)
    x ^= x >> U(33)
    return x


def lookup(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


IS_SPACE = lookup(SPACES)
#: Separators for words made of ASCII letters, digits and any non-ASCII byte.
IS_PUNCT = lookup(b for b in range(128) if not chr(b).isalnum())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and len + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    return _powers(max(2 * PIECE, 1 << int(n).bit_length()))


def word_spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-separators inside a text, and word offsets per text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = sep[buf]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[off[:-1][off[:-1] < len(buf)]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (ascending, disjoint): a prefix-sum polynomial, then the finaliser."""
    out = np.zeros(len(start), U)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, "right")))
        a, b = start[lo], end[hi - 1]
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, U)
        np.cumsum((buf[a:b].astype(U) + U(1)) * up[: b - a], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        lo = hi
    return out


def words(texts, sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, ASCII letters folded, and word offsets per text."""
    buf, off = buffer_of(texts)
    buf = LOWER[buf]
    start, end, woff = word_spans(buf, off, sep)
    return span_hashes(buf, start, end), woff


def ngrams(w: np.ndarray, woff: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text and their offsets.

    With whole_if_short, a text of 1 to n - 1 words has one shingle, its whole sequence.
    """
    count = np.diff(woff)
    mult = mix(np.arange(1, n + 1, dtype=U))
    mult |= U(1)
    if len(w) >= n:
        acc = np.full(len(w) - n + 1, n, U)
        for j in range(n):
            acc += w[j : len(w) - n + 1 + j] * mult[j]
    else:
        acc = np.zeros(0, U)
    last = np.repeat(woff[1:], count)[: len(acc)]
    keep = np.arange(len(acc)) + n <= last
    full = np.maximum(count - n + 1, 0)
    if not whole_if_short or not (short := np.flatnonzero((count > 0) & (count < n))).size:
        return mix(acc[keep]), np.concatenate([[0], np.cumsum(full)])
    one = np.zeros(len(short), U) + count[short].astype(U)
    for j in range(n - 1):
        has = count[short] > j
        one[has] += w[woff[short[has]] + j] * mult[j]
    full_off = np.concatenate([[0], np.cumsum(full)])
    out = np.insert(acc[keep], full_off[short], one)
    full[short] = 1
    return mix(out), np.concatenate([[0], np.cumsum(full)])


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    values = values.copy()
    for a, b in zip(off[:-1], off[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[off[:-1][off[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[off]


def blocks(off: np.ndarray, size: int):
    """Ranges of texts of about `size` items each; a longer text is alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def rolling(buf: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of every substring of the given lengths, joined from powers of two.

    Entry p of result[n] covers buf[p : p + n]; it has len(buf) - n + 1 entries.
    """
    unit = buf.astype(U) + U(1)
    have = {1: unit}

    def join(a: int, b: int) -> np.ndarray:
        n = len(buf) - a - b + 1
        if n <= 0:
            return np.zeros(0, U)
        return have[a][:n] * U(pow(BASE, b, 1 << 64)) + have[b][a : a + n]

    out, step = {}, 1
    while 2 * step <= max(lengths):
        have[2 * step] = join(step, step)
        step *= 2
    for n in lengths:
        at, bit = 0, step
        while bit:
            if n & bit:
                if at and at + bit not in have:
                    have[at + bit] = join(at, bit)
                at += bit
            bit >>= 1
        out[n] = mix(have[n])
    return out
