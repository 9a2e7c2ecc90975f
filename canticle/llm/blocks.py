"""Documents packed into compressed blocks, so that passes over texts move few large rows.

A block is one row: its number, the doc_ids, byte lengths and tags of its documents, and their UTF-8
bytes, zstd-compressed.  Blocks are written once to the shared folder; every pass reads the same ones.
"""

from __future__ import annotations

import copy
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from canticle.llm import kernels as K
from canticle.llm.storage import Scratch

#: Bytes of text in a block; a longer document has a block of its own.
BLOCK_BYTES = 3 << 20
SCHEMA = "block long, n_bytes long, ids binary, known binary, sizes binary, tags binary, text binary"


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each a process: making them costs as much as a small message."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x) -> bytes:
    return _codec()[0].compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(x), dtype)


def _pack(block_bytes: int, across: bool):
    return lambda batches: _packed(_filled(batches, block_bytes) if across else batches, block_bytes)


def _filled(batches, block_bytes: int):
    """The rows of batches in batches that fill whole blocks, but for the last."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= block_bytes:
            b = pa.concat_batches(held)
            full = list(K.blocks(K.buffer_of(b.column(1))[1], block_bytes))[-1][0] or b.num_rows
            yield b[:full]
            held = [b[full:]] if full < b.num_rows else []
            size = sum(x.column(1).nbytes for x in held)
    if held:
        yield pa.concat_batches(held)


def _packed(batches, block_bytes: int):
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    for b in batches:
        buf, off = K.buffer_of(b.column(1))
        ids = b.column(0)
        known = np.array(ids.is_valid())
        ids = np.array(ids.fill_null(0), np.int64)
        tags = np.array(b.column(2), np.int8)
        for lo, hi in K.blocks(off, block_bytes):
            part = slice(lo, hi)
            yield pa.record_batch(
                {
                    "block": pa.array([number], pa.int64()),
                    "n_bytes": pa.array([int(off[hi] - off[lo])], pa.int64()),
                    "ids": [ids[part].tobytes()],
                    "known": [known[part].tobytes()],
                    "sizes": [np.diff(off[lo : hi + 1]).tobytes()],
                    "tags": [tags[part].tobytes()],
                    "text": [squeeze(buf[off[lo] : off[hi]])],
                }
            )
            number += 1


def pack(scratch: Scratch, docs: DataFrame, block_bytes: int = BLOCK_BYTES, across: bool = False) -> DataFrame:
    """The block table of docs (doc_id long, text string, tag tinyint); a null text is empty.

    across: whether a block takes texts of several Arrow batches until it is full.
    """
    return scratch.table(docs.mapInArrow(_pack(block_bytes, across), SCHEMA), "blocks")


class Block:
    """One row of a block table, opened."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, tags: bytes, text: bytes):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        self.off = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
        self.tags = np.frombuffer(tags, np.int8)
        self.buf = unsqueeze(text)

    def parts(self, size: int):
        """The block in blocks of about `size` bytes, in order."""
        for lo, hi in K.blocks(self.off, size):
            part = copy.copy(self)
            part.ids, part.known, part.tags = self.ids[lo:hi], self.known[lo:hi], self.tags[lo:hi]
            part.off, part.buf = self.off[lo : hi + 1] - self.off[lo], self.buf[self.off[lo] : self.off[hi]]
            yield part


def opened(batch):
    """(block number, Block) of each row of a batch that has a block table's columns."""
    columns = [batch.column(c) for c in ("block", "ids", "known", "sizes", "tags", "text")]
    for number, *parts in zip(*columns, strict=True):
        yield number.as_py(), Block(*(p.as_py() for p in parts))


def dealt(bucket: np.ndarray, n: int):
    """(bucket, from, to) of each run of an ascending bucket column."""
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])
