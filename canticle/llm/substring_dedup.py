"""Substring dedup: bytes covered by 50-byte strings that also start in an earlier document.

Equal strings are brought together by content.  The anchor of a window of 50 bytes is the least hash
among its 16-byte strings, so equal windows have equal anchors.

1. Documents are packed into blocks, and neighbouring blocks into packs; each tells the distinct anchors of its windows.
2. Anchors are dealt into buckets, which answer every block: occurs elsewhere, or not, or is hot.
3. Blocks send the segments of text whose anchors repeat to the anchors' buckets, equal segments once
   with the least doc_id.  Windows of a hot anchor (one with very many segments) go one by one
   to buckets of their own hash, so no bucket holds a hot passage's surroundings.
4. A bucket sorts the suffixes of its segments (suffix_array) and tells each window whether an equal
   one starts in a document with a smaller doc_id.
5. Blocks cover the bytes and write what is left.

Answers are bits; blocks rebuild the order in which they asked, so no text or key travels back.  A message
goes from a pack to a shelf of neighbouring buckets, so there are few even where blocks and buckets are many.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import blocks as B
from canticle.llm import kernels as K
from canticle.llm.storage import Scratch
from canticle.llm.suffix_array import equal_windows

U = K.U
LENGTH, GRAM = 50, 16
#: Windows of a segment at most.
CUT = 64
#: Text bytes a bucket stands for; the number of buckets follows from the input.
BUCKET_BYTES = 1 << 18
#: Blocks of a pack; they are worked on one after the other.
PACK = 4
#: Shelves that are made before one holds several buckets, and the buckets of a shelf at most; they are sorted one after the other.
SHELVES, SHELF = 128, 32
#: Segments of an anchor, over all blocks, before its windows are dealt one by one.
HOT_SEGMENTS = 1 << 14
PIECE = 1 << 17
NONE, REPEATED, HOT = 0, 1, 2


def before(sizes: np.ndarray) -> np.ndarray:
    """The sum of the sizes in front of each."""
    return np.cumsum(sizes) - sizes


def window_anchors(buf: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position, worked out in pieces that fit the cache."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    reach = LENGTH - GRAM + 1
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        h = K.rolling(buf[lo : hi + LENGTH - 1], (GRAM,))[GRAM]
        size = 1
        while 2 * size <= reach:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        rest = reach - size
        out[lo:hi] = np.minimum(h[: hi - lo], h[rest : rest + hi - lo]) if rest else h[: hi - lo]
    return out


def repeats(data: np.ndarray, begin: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether each stretch of data equals the one before it; equal marks are compared byte by byte."""
    same = np.zeros(len(mark), bool)
    i = np.flatnonzero((mark[1:] == mark[:-1]) & (size[1:] == size[:-1]))
    if len(i):
        length = size[i]
        into = np.arange(length.sum()) - np.repeat(before(length), length)
        equal = data[np.repeat(begin[i], length) + into] == data[np.repeat(begin[i + 1], length) + into]
        same[i[np.logical_and.reduceat(equal, before(length))] + 1] = True
    return same


class Windows:
    """The windows of a block's documents that have a doc_id, in runs of one anchor."""

    def __init__(self, block: B.Block, n_buckets: int):
        self.block, self.n_buckets = block, n_buckets
        anchors = window_anchors(block.buf)
        n, off = len(anchors), block.off
        # A window may start where a document with a doc_id has LENGTH bytes left.
        edge = np.zeros(len(block.buf) + 1, np.int8)
        use = block.known & (np.diff(off) >= LENGTH)
        edge[off[:-1][use]] += 1
        edge[off[1:][use] - LENGTH + 1] -= 1
        usable = np.cumsum(edge[:n], dtype=np.int8) > 0
        new = usable.copy()
        new[1:] &= (anchors[1:] != anchors[:-1]) | ~usable[:-1]
        begins = off[:-1][use]
        new[begins[begins < n]] = True
        last = usable.copy()
        last[:-1] &= new[1:] | ~usable[1:]
        self.start = np.flatnonzero(new)
        self.count = np.flatnonzero(last) - self.start + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        key, self.which = np.unique(K.mix(anchors[self.start]), return_inverse=True)
        order = np.lexsort((key, key % U(n_buckets)))
        self.key = key[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.which = back[self.which]
        self.bucket = (self.key % U(n_buckets)).astype(np.int64)

    def sizes(self) -> np.ndarray:
        """How many segments the block would send for each anchor, equal ones once; up to 65,535."""
        pieces = -(-self.count // CUT)
        often = np.bincount(self.which, minlength=len(self.key))[self.which] > 1
        start, which = self.start[often], self.which[often]
        mark = K.mix(K.span_hashes(self.block.buf, start, start + self.count[often] + LENGTH - 1) + which.astype(U))
        once = ~often
        once[np.flatnonzero(often)[np.unique(mark, return_index=True)[1]]] = True
        return np.minimum(np.bincount(self.which[once], pieces[once], len(self.key)), 65535).astype(np.uint16)

    def shared_inside(self) -> np.ndarray:
        """Whether each anchor is in two documents of this block."""
        ids = self.block.ids[self.doc]
        low, high = np.full(len(self.key), np.iinfo(np.int64).max), np.full(len(self.key), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high

    def segments(self, code: np.ndarray) -> Segments:
        """What the block sends: segments of repeated anchors, windows of hot ones."""
        kind = code[self.which]
        start, count, doc, bucket = (x[kind == REPEATED] for x in (self.start, self.count, self.doc, self.bucket[self.which]))
        pieces = -(-count // CUT)
        nth = np.arange(pieces.sum()) - np.repeat(before(pieces), pieces)
        count = np.minimum(np.repeat(count, pieces) - nth * CUT, CUT)
        start, doc, bucket = np.repeat(start, pieces) + nth * CUT, np.repeat(doc, pieces), np.repeat(bucket, pieces)
        hot = kind == HOT
        each = self.count[hot]
        nth = np.arange(each.sum()) - np.repeat(before(each), each)
        single = np.repeat(self.start[hot], each) + nth
        grams = self._window_hash(single)
        start = np.concatenate([start, single])
        count = np.concatenate([count, np.ones(len(single), np.int64)])
        doc = np.concatenate([doc, np.repeat(self.doc[hot], each)])
        bucket = np.concatenate([bucket, (grams % U(self.n_buckets)).astype(np.int64)])
        return Segments(self.block, start, count, doc, bucket)

    def _window_hash(self, at: np.ndarray) -> np.ndarray:
        buf = self.block.buf.astype(U)
        h = np.zeros(len(at), U)
        for i in range(LENGTH):
            h = h * U(K.BASE) + buf[at + i] + U(1)
        return K.mix(h)


class Segments:
    """Segments in the order in which they are sent, equal ones of a bucket once."""

    def __init__(self, block: B.Block, start, count, doc, bucket):
        size = count + LENGTH - 1
        flat = np.repeat(start - before(size), size) + np.arange(size.sum())
        data = block.buf[flat]
        begin = before(size)
        mark = K.span_hashes(data, begin, begin + size)
        order = np.lexsort((block.ids[doc], mark, count, bucket))
        start, count, doc, bucket = (x[order] for x in (start, count, doc, bucket))
        same = repeats(data, begin[order], size[order], mark[order]) if len(order) else np.zeros(0, bool)
        same[1:] &= bucket[1:] == bucket[:-1]
        self.head = np.cumsum(~same) - 1
        self.start, self.count, self.doc = start, count, doc
        heads = np.flatnonzero(~same)
        self.low = block.ids[doc[heads]]
        self.sent_count, self.sent_bucket, self.sent_start = count[heads], bucket[heads], start[heads]
        self.block = block

    def rows(self, deal: Deal):
        """(shelf, windows of each segment with its bucket's place on the shelf in the high byte, least doc_ids, text) of what is sent."""
        for shelf, lo, hi in deal.shelves(self.sent_bucket):
            size = self.sent_count[lo:hi] + LENGTH - 1
            flat = np.repeat(self.sent_start[lo:hi] - before(size), size) + np.arange(size.sum())
            counts = self.sent_bucket[lo:hi] % deal.shelf * 256 + self.sent_count[lo:hi]
            yield shelf, counts.astype(np.uint16), self.low[lo:hi], self.block.buf[flat]

    def covered(self, bits: np.ndarray) -> np.ndarray:
        """Which bytes of the block the windows cover that start in an earlier document."""
        base = np.concatenate([[0], np.cumsum(self.sent_count)])[:-1]
        n = self.count
        nth = np.arange(n.sum()) - np.repeat(before(n), n)
        later = self.block.ids[self.doc] > self.low[self.head] if len(n) else np.zeros(0, bool)
        hit = np.repeat(later, n) | (bits[np.repeat(base[self.head], n) + nth] if len(n) else np.zeros(0, bool))
        at = (np.repeat(self.start, n) + nth)[hit]
        edge = np.bincount(at, minlength=len(self.block.buf) + 1) - np.bincount(at + LENGTH, minlength=len(self.block.buf) + 1)
        return np.cumsum(edge)[: len(self.block.buf)] > 0


class Deal(NamedTuple):
    """How anchors are dealt: buckets, buckets of a shelf, and bytes of a block."""

    buckets: int
    shelf: int
    block_bytes: int

    def shelves(self, bucket: np.ndarray):
        """(shelf, from, to) of each run of an ascending bucket column."""
        return B.dealt(bucket // self.shelf, -(-self.buckets // self.shelf))

    def blocks(self, batch):
        """Number of each pack of a batch (a row of a block table), and its blocks."""
        for number, pack in B.opened(batch):
            yield number, pack.parts(self.block_bytes)


class Messages:
    """What a pack sends to each shelf: its blocks' arrays one behind the other."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def add(self, shelf: int, *arrays: np.ndarray) -> None:
        self.parts.setdefault(shelf, []).append(arrays)

    def batch(self, number: int, **written) -> pa.RecordBatch:
        """A row a shelf; written: what makes bytes of each array, by the column's name."""
        columns = [[] for _ in written]
        for parts in self.parts.values():
            for column, write, arrays in zip(columns, written.values(), zip(*parts, strict=True), strict=True):
                column.append(write(np.concatenate(arrays)))
        return pa.record_batch([pa.array(list(self.parts), pa.int32()), pa.array([number] * len(self.parts), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], ["shelf", "block", *written])


class Replies:
    """What came back to a pack from each shelf, taken block by block in the order in which it was sent."""

    def __init__(self, rows, read):
        self.parts = {x["shelf"]: read(x) for x in rows or []}
        self.taken = dict.fromkeys(self.parts, 0)

    def take(self, counts: list[tuple[int, int]]) -> np.ndarray:
        """The next so many of each (shelf, count)."""
        out = [np.zeros(0, np.uint8)]
        for shelf, n in counts:
            out.append(self.parts[shelf][self.taken[shelf] : self.taken[shelf] + n])
            self.taken[shelf] += n
        return np.concatenate(out)


def _ask(deal: Deal):
    def run(batches):
        for batch in batches:
            for number, blocks in deal.blocks(batch):
                out = Messages()
                for block in blocks:
                    w = Windows(block, deal.buckets)
                    short = (w.key >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                    inside, sizes = w.shared_inside(), w.sizes()
                    for shelf, lo, hi in deal.shelves(w.bucket):
                        out.add(shelf, short[lo:hi], inside[lo:hi], sizes[lo:hi])
                yield out.batch(number, keys=lambda x: x.tobytes(), inside=lambda x: np.packbits(x).tobytes(), sizes=B.squeeze)

    return run


def _answer(hot_segments: int, hot_blocks: int | None):
    return lambda group: _answered(group, hot_segments, hot_blocks)


def _answered(group: pa.Table, hot_segments: int, hot_blocks: int | None) -> pa.Table:
    """For each pack's anchors of one shelf: whether another document has them too, or too many segments do."""
    keys, inside, sizes = [], [], []
    for key, shared, size in zip(group["keys"], group["inside"], group["sizes"], strict=True):
        part = np.zeros((len(key.as_py()) // 5, 8), np.uint8)
        part[:, :5] = np.frombuffer(key.as_py(), np.uint8).reshape(-1, 5)
        keys.append(part.view(U).reshape(-1))
        inside.append(np.unpackbits(np.frombuffer(shared.as_py(), np.uint8), count=len(part)))
        sizes.append(B.unsqueeze(size.as_py(), np.uint16))
    _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hot = np.bincount(which, np.concatenate(sizes)) > hot_segments
    if hot_blocks is not None:
        hot |= count > hot_blocks
    repeated = (count > 1) | (np.bincount(which, np.concatenate(inside)) > 0)
    code = np.where(repeated, np.where(hot, HOT, REPEATED), NONE).astype(np.uint8)[which]
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    out = [B.squeeze(code[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"block": group["block"], "shelf": group["shelf"], "codes": out})


def _segments(deal: Deal, blocks, answers):
    """Each block's segments that go to buckets, by the answers to its pack."""
    codes = Replies(answers, lambda x: B.unsqueeze(x["codes"]))
    for block in blocks:
        w = Windows(block, deal.buckets)
        yield block, w.segments(codes.take([(shelf, hi - lo) for shelf, lo, hi in deal.shelves(w.bucket)]))


def _send(deal: Deal):
    def run(batches):
        for batch in batches:
            for (number, blocks), answers in zip(deal.blocks(batch), batch.column("answers").to_pylist(), strict=True):
                out = Messages()
                for _, segments in _segments(deal, blocks, answers):
                    for row in segments.rows(deal):
                        out.add(*row)
                yield out.batch(number, counts=B.squeeze, low=B.squeeze, text=B.squeeze)

    return run


def _sort(group: pa.Table) -> pa.Table:
    """For each window of a shelf's segments: whether an equal one starts in an earlier document."""
    counts = [B.unsqueeze(x.as_py(), np.uint16) for x in group["counts"]]
    low = np.concatenate([B.unsqueeze(x.as_py(), np.int64) for x in group["low"]])
    text = np.concatenate([B.unsqueeze(x.as_py()) for x in group["text"]])
    bucket, n = np.divmod(np.concatenate(counts).astype(np.int64), 256)
    ends = np.cumsum(n + LENGTH - 1)
    starts = ends - (n + LENGTH - 1)
    mark = K.span_hashes(text, starts, ends)
    first, earlier = before(n), np.zeros(n.sum(), bool)
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        at = np.repeat(first[mine] - before(n[mine]), n[mine])
        at += np.arange(len(at))
        earlier[at] = _sorted(text, starts[mine], ends[mine], n[mine], low[mine], mark[mine])
    edges = np.concatenate([[0], np.cumsum([(c & 255).sum(dtype=np.int64) for c in counts])])
    bits = [B.squeeze(np.packbits(earlier[edges[i] : edges[i + 1]])) for i in range(len(counts))]
    return pa.table({"block": group["block"], "shelf": group["shelf"], "bits": bits, "n": np.diff(edges)})


def _sorted(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each window of a bucket's segments, which are stretches of the text: whether an equal one starts in an earlier document."""
    # Segments that several blocks sent are sorted once, for the least of their documents.
    order = np.lexsort((mark, n))
    heads = np.flatnonzero(~repeats(text, starts[order], (ends - starts)[order], mark[order]))
    alike = np.empty(len(n), np.int64)
    alike[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(n))))
    kept = order[heads]
    least = np.minimum.reduceat(low[order], heads)
    size, count = (ends - starts)[kept], n[kept]
    flat = np.repeat(starts[kept] - before(size), size)
    flat += np.arange(len(flat))
    text = text[flat]
    del flat, mark, order
    starts, first = before(size), before(count)
    p = np.repeat(starts - first, count) + np.arange(count.sum())
    owner = np.repeat(least, count)
    minimum = np.empty(len(p), np.int64)
    for order, heads in equal_windows(text, starts, starts + size, p, LENGTH):
        minimum[order] = np.repeat(np.minimum.reduceat(owner[order], heads), np.diff(np.append(heads, len(order))))
    return minimum[np.repeat(first[alike] - before(n), n) + np.arange(n.sum())] < np.repeat(low, n)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(deal: Deal, with_text: bool):
    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("answers", "found"))
            for (_, blocks), answers, found in zip(deal.blocks(batch), *columns, strict=True):
                bits = Replies(found, lambda x: np.unpackbits(B.unsqueeze(x["bits"]), count=x["n"]))
                for block, segments in _segments(deal, blocks, answers):
                    runs = deal.shelves(segments.sent_bucket)
                    gone = segments.covered(bits.take([(shelf, int(segments.sent_count[lo:hi].sum())) for shelf, lo, hi in runs]).astype(bool))
                    sizes, removed, spans, digests, kept = [], [], [], [], []
                    for a, b in zip(block.off[:-1], block.off[1:], strict=True):
                        part = gone[a:b]
                        left = block.buf[a:b] if not part.any() else block.buf[a:b][~part]
                        sizes.append(b - a)
                        removed.append(b - a - len(left))
                        spans.append(int(part[:1].sum() + (part[1:] & ~part[:-1]).sum()))
                        digests.append(hashlib.sha256(left.tobytes()).hexdigest())
                        kept.append(left.tobytes() if with_text else None)
                    ids = pa.array(block.ids, pa.int64(), mask=~block.known)
                    yield pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(
    spark: SparkSession, docs: DataFrame, with_text: bool = False, block_bytes: int = B.BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int | None = None, hot_segments: int = HOT_SEGMENTS, shelves: int = SHELVES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row of docs.

    docs: doc_id, text.  A byte goes if it lies in a 50-byte string of its document that also starts
    in a document with a smaller doc_id; all strings are those of the input.  Null texts are empty;
    texts below 50 bytes are left alone; a row without doc_id neither removes nor loses anything;
    rows that repeat a doc_id do not remove each other's bytes.  Other columns are ignored.
    hot_segments, hot_blocks: an anchor with more segments, or in more blocks, is hot.
    """
    scratch = Scratch(spark, "substring-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("tinyint").alias("tag"))
    packs = B.pack(scratch, rows, PACK * block_bytes, across=True)
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    deal = Deal(n, min(SHELF, max(1, n // shelves)), block_bytes)
    asked = packs.mapInArrow(_ask(deal), "shelf int, block long, keys binary, inside binary, sizes binary")
    answers = asked.groupBy("shelf").applyInArrow(_answer(hot_segments, hot_blocks), "block long, shelf int, codes binary")
    answers = scratch.table(answers.groupBy("block").agg(F.collect_list(F.struct("shelf", "codes")).alias("answers")), "answers")
    with_answers = packs.join(answers.hint("shuffle_hash"), "block", "left")
    sent = with_answers.mapInArrow(_send(deal), "shelf int, block long, counts binary, low binary, text binary")
    found = sent.groupBy("shelf").applyInArrow(_sort, "block long, shelf int, bits binary, n long")
    found = scratch.table(found.groupBy("block").agg(F.collect_list(F.struct("shelf", "bits", "n")).alias("found")), "found")
    both = packs.join(answers.join(found, "block", "left"), "block", "left")
    out = both.mapInArrow(_finish(deal, with_text), DIGEST)
    return out if with_text else out.drop("kept")
