"""Blockwise suffix sorting with a difference cover, in numpy.

A perfect difference cover D of the residues modulo 31 has, for any two positions a and b, a shift
below 31 that takes both into the sample {p : p mod 31 in D}.  The sample's ranks are computed once.
Suffixes are then sorted one bucket of leading bytes at a time: by their first 32 bytes, and where
those tie by the ranks at the common shift.  Memory is bounded by a bucket, however long ties are.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: A perfect difference cover modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Suffixes sorted at once.
BUCKET = 1 << 20


def shifts() -> np.ndarray:
    """shift[a mod 31, b mod 31]: the least d with a + d and b + d in the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    member = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    for d in range(PERIOD - 1, -1, -1):
        out[np.outer(member[d : d + PERIOD], member[d : d + PERIOD])] = d
    return out


SHIFT = shifts()


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)])
    out = np.zeros(len(padded) - 8, U)
    for i in range(8):
        out |= padded[i : len(padded) - 8 + i].astype(U) << U(56 - 8 * i)
    return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal keys alike."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), U)
    out[order] = np.cumsum(new)
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << U(32)) | right


class Prefixes:
    """Ranks of the first 16 bytes of every position within its segment, by doubling from 8."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        left = ends - np.arange(len(text))
        short = np.minimum(left, 8).astype(U)
        first = eights(text)[: len(text)] & (~U(0) << (U(8) * (U(8) - short)))
        self.ends = ends
        eight = dense(first)
        del first, left, short
        self.rank = dense(joined(eight, self.behind(eight, np.arange(len(text)), 8)))

    def behind(self, rank: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """Ranks `shift` bytes further on; 0, below all, where the segment has ended."""
        there = at + shift
        inside = there < self.ends[at]
        return np.where(inside, rank[np.where(inside, there, 0)], U(0))


def sample_ranks(prefix: Prefixes, depth: int) -> np.ndarray:
    """Ranks of the cover's positions by their next `depth` (32 to 64) bytes; -1 elsewhere."""
    n = len(prefix.ends)
    rank = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    half = dense(joined(prefix.rank[at], prefix.behind(prefix.rank, at, 16)))
    rest = dense(joined(prefix.behind(prefix.rank, at, 32), prefix.behind(prefix.rank, at, depth - 16)))
    rank[at] = dense(joined(half, rest))
    return rank


def refined(p: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of positions within their groups (ascending, equal in 32 bytes) by cover ranks.

    Three-way quicksort of all groups at once; a comparison is one look-up at the common shift.
    """
    order = np.arange(len(p))
    low = np.searchsorted(group, group)
    high = np.searchsorted(group, group, "right")
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        pivot = p[order[(low[open_] + high[open_] - 1) // 2]]
        mine = p[order[open_]]
        d = SHIFT[mine % PERIOD, pivot % PERIOD]
        side = np.sign(rank[mine + d] - rank[pivot + d]) + 1
        by = np.lexsort((side, low[open_]))
        order[open_] = order[open_[by]]
        key = low[open_] * 3 + side[by]
        start = np.searchsorted(key, key)
        stop = np.searchsorted(key, key, "right")
        # Positions of a group are neighbours, so indexes into open_ are offsets from its start.
        base = low[open_] - np.searchsorted(low[open_], low[open_])
        low[open_], high[open_] = base + start, base + stop
        open_ = open_[(stop - start > 1) & (key % 3 != 1)]
    return order


def equal_windows(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray, depth: int):
    """Groups of positions p whose next `depth` bytes agree, as (sorted positions' index, group start) per bucket.

    starts, ends: the segments of the text; each p has `depth` bytes left in its segment.
    """
    if not len(p):
        return
    prefix = Prefixes(text, np.repeat(ends, ends - starts))
    rank = sample_ranks(prefix, depth)
    r = prefix.rank
    # Buckets of suffixes by the rank of their leading bytes.
    lead = r[p]
    edges = bucket_edges(lead)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        mine = np.flatnonzero((lead >= low) & (lead < high)) if len(edges) > 2 else np.arange(len(p))
        key = joined(lead[mine], r[p[mine] + 16])
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        mine = mine[order]
        mine = mine[refined(p[mine], np.cumsum(new), rank)]
        q = p[mine]
        # Neighbours in suffix order: those with a common prefix of the whole depth are equal windows.
        differ = np.ones(len(q), bool)
        differ[1:] = False
        for c in (0, 16, depth - 16) if depth <= 48 else (0, 16, 32, depth - 16):
            x = r[q + c]
            differ[1:] |= x[1:] != x[:-1]
        yield mine, np.flatnonzero(differ)


def bucket_edges(lead: np.ndarray) -> list[int]:
    """Bounds of ranges of leading ranks, each with about BUCKET suffixes or one leading rank."""
    top = int(lead.max()) + 1
    if len(lead) <= BUCKET:
        return [0, top]
    running = np.cumsum(np.bincount(lead.astype(np.int64), minlength=top))
    edges = [0]
    while edges[-1] < top:
        done = running[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(running, done + BUCKET, "right"))))
    return edges
