"""Merkle manifest of a table: a tree of fanout 8 for each part, a tree over the parts' roots, proofs of rows.

Leaves are hashed in the JVM and placed by a range sort, so that a part of any size is dealt over tasks
as aligned blocks of 8^4 consecutive leaves.  Within a block the hex digests stand in one contiguous
numpy matrix of 64 bytes a row; eight rows are 512 consecutive bytes, so a level is hashed run by run
and every sibling is found by index arithmetic.  The roots of blocks are the leaves of the next pass,
until a part has one node; then the way back gives each block what its leaves' proofs need from above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canticle.llm import kernels as K
from canticle.llm.storage import Scratch

FANOUT, HEX = 8, 64
#: Levels of a block: it has 8^4 = 4,096 leaves of 64 bytes each at most.
LEVELS = 4
#: Rows of a range when leaves are placed.
RANGE_ROWS = 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(parts) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest().encode()


def encoded(*values: Column) -> Column:
    """The concatenation of each value's UTF-8 byte count, a colon and the value; `-` for a null."""
    texts = (v.cast("string") for v in values)
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def levels(hexes: np.ndarray, whole: int) -> list[np.ndarray]:
    """The matrices of a block from its leaves up to one node, or `whole` levels up where that is not 0."""
    out = [np.ascontiguousarray(hexes)]
    while len(out) <= whole if whole else len(out[-1]) > 1:
        rows = memoryview(out[-1]).cast("B")
        size = FANOUT * HEX
        nodes = b"".join(sha((rows[i : i + size],)) for i in range(0, len(rows), size))
        out.append(np.frombuffer(nodes, np.uint8).reshape(-1, HEX))
    return out


def siblings(tree: list[np.ndarray]):
    """A function from a leaf's place to (left, right) of each level: the bytes beside it in its run."""
    flat = [memoryview(m).cast("B") for m in tree[:-1]]

    def of(leaf: int) -> list[tuple]:
        out = []
        for rows in flat:
            run = leaf // FANOUT * FANOUT * HEX
            own = leaf * HEX
            out.append((rows[run:own], rows[own + HEX : run + FANOUT * HEX]))
            leaf //= FANOUT
        return out

    return of


def matrix(column) -> np.ndarray:
    """A string column of 64-character digests as a matrix of their bytes."""
    return K.buffer_of(column)[0].reshape(-1, HEX)


def _opened(group: pa.Table):
    """The group in order of place, and its levels."""
    group = group.sort_by("pos")
    return group, levels(matrix(group["hash"]), group["whole"][0].as_py())


def _root(group: pa.Table) -> pa.Table:
    group, tree = _opened(group)
    return pa.table({"part": group["part"][:1], "pos": group["block"][:1], "hash": [tree[-1].tobytes().decode()]})


def _paths(group: pa.Table) -> pa.Table:
    """What each node's proof needs from its level up: (left, right) of its block's levels, then the block's own."""
    group, tree = _opened(group)
    of = siblings(tree)
    left, right = group["left"][0].as_py(), group["right"][0].as_py()
    beside = [of(i) for i in range(len(group))]
    return pa.table(
        {
            "part": group["part"],
            "pos": group["pos"],
            "left": [[bytes(a).decode() for a, _ in x] + left for x in beside],
            "right": [[bytes(b).decode() for _, b in x] + right for x in beside],
        },
        schema=pa.schema([("part", pa.string()), ("pos", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]),
    )


def _proofs(group: pa.Table) -> pa.Table:
    """The proof of each leaf, and the root that its leaf, or what stands in its place, folds to."""
    group, tree = _opened(group)
    of = siblings(tree)
    above = [(a.encode(), b.encode()) for a, b in zip(group["left"][0].as_py(), group["right"][0].as_py(), strict=True)]
    subroot = group["subroot"][0].as_py()
    proofs, folded = [], []
    for i, node in enumerate(group["seen"].to_pylist()):
        path = [*of(i), *above]
        proofs.append(sha(x for pair in path for x in pair).decode())
        node = node.encode()
        for left, right in path:
            node = sha((left, node, right))
        folded.append(node.decode())
    return pa.table({"doc_id": group["doc_id"], "leaf": group["hash"], "subroot": [subroot] * len(group), "proof_sha256": proofs, "folded_root": folded})


def placed(scratch: Scratch, rows: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """rows with pos (from 0) and nodes, their place in and the number of their part, by a range sort.

    rows: part and the columns of order.  Only counts of ranges meet in a window, not rows.
    """
    ranges = max(1, -(-n // RANGE_ROWS))
    keys = [F.col("part").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = scratch.table(ordered.withColumn("_range", F.shiftright("_at", 33)), name)
    counts = ordered.groupBy("part", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy("part")
    before = by_part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("nodes", F.sum("_n").over(by_part))
    counts = scratch.table(counts.select(F.col("part").alias("_part"), F.col("_range").alias("_own"), "_first", "_before", "nodes"), f"{name}-ranges")
    joined = ordered.join(counts, (F.col("_range") == F.col("_own")) & F.col("part").eqNullSafe(F.col("_part")))
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_part", "_own", "_first", "_before")


def tree(scratch: Scratch, leaves: DataFrame, most: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The passes over leaves (part, pos, nodes, hash) of parts of at most `most` leaves, and (part, hash) of each part's root.

    A pass has blocks of `height` levels; whole is that for the blocks of a part of several.
    """
    passes, nodes, size = [], leaves, FANOUT**height
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long")).withColumn("whole", F.when(F.col("nodes") > size, height).otherwise(0))
        passes.append(nodes)
        roots = nodes.select("part", "pos", "whole", "hash", "block").groupBy("part", "block").applyInArrow(_root, "part string, pos long, hash string")
        count = nodes.groupBy("part").agg(F.max("nodes").alias("_nodes")).withColumnRenamed("part", "_part")
        roots = roots.join(count, F.col("part").eqNullSafe(F.col("_part")))
        up = scratch.table(roots.select("part", "pos", F.ceil(F.col("_nodes") / size).cast("long").alias("nodes"), "hash"), f"roots-{len(passes)}")
        most = -(-most // size)
        if most <= 1:
            return passes, up.select("part", "hash")
        nodes = up


def manifest(spark: SparkSession, rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each of rows.

    rows: part, doc_id, leaf and seen, the leaf that is to be verified.  A part's leaves ascend by doc_id
    (null first), then by leaf, so rows that repeat a doc_id have a place; equal rows are equal leaves.
    Parts ascend by name in UTF-8 bytes, a null part first.  A part of one leaf has it as its root, and
    one part's root is the root of all.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "merkle")
    n = rows.count()
    leaves = placed(scratch, rows.withColumnRenamed("leaf", "hash").select(F.col("part").cast("string").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "hash", "seen"), ["doc_id", "hash"], n, "leaves")
    leaves = scratch.table(leaves, "placed")
    sizes = leaves.groupBy("part").agg(F.max("nodes").alias("n"))
    total = sizes.agg(F.max("n").alias("most"), F.count("*").alias("parts")).first()
    passes, subroots = tree(scratch, leaves, total["most"] or 1, height)

    # The parts' roots are the leaves of one more tree.
    tops = scratch.table(placed(scratch, subroots.select(F.lit("").alias("part"), F.struct(F.col("part").alias("name")).alias("named"), "hash"), ["named"], total["parts"], "parts"), "parts-placed")
    upper, found = tree(scratch, tops, total["parts"], height)
    paths = _down(scratch, upper, None)
    tops = tops.join(paths, ["part", "pos"]).select(F.col("named.name").alias("part"), F.col("hash").alias("subroot"), "left", "right")
    root = found.first()  # one row, or none of an empty table
    last = _joined(_down(scratch, passes[1:], tops) if len(passes) > 1 else None, passes[0], tops)
    out = last.groupBy("part", "block").applyInArrow(_proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(root["hash"] if root else None).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _joined(paths: DataFrame | None, nodes: DataFrame, tops: DataFrame | None) -> DataFrame:
    """nodes with the (left, right) that stand above their block: the block's own path, or its part's where it is the only one."""
    none = F.array().cast("array<string>")
    if tops is None:
        nodes = nodes.withColumn("subroot", F.lit(None).cast("string"))
        tops_left = nodes.withColumn("left", none).withColumn("right", none) if paths is None else nodes
    else:
        named = tops.select(F.col("part").alias("_part"), "subroot", "left", "right") if paths is None else tops.select(F.col("part").alias("_part"), "subroot")
        tops_left = nodes.join(named, F.col("part").eqNullSafe(F.col("_part"))).drop("_part")
    if paths is None:
        return tops_left
    above = paths.select(F.col("part").alias("_part"), F.col("pos").alias("_block"), "left", "right")
    return tops_left.join(above, (F.col("block") == F.col("_block")) & F.col("part").eqNullSafe(F.col("_part"))).drop("_part", "_block")


def _down(scratch: Scratch, passes: list[DataFrame], tops: DataFrame | None) -> DataFrame:
    """part, pos, left and right of every node of the lowest of these passes."""
    paths = None
    for nodes in reversed(passes):
        grouped = _joined(paths, nodes, tops).select("part", "pos", "whole", "hash", "block", "left", "right").groupBy("part", "block")
        paths = scratch.table(grouped.applyInArrow(_paths, "part string, pos long, left array<string>, right array<string>"), "paths")
    return paths


def document_leaves(docs: DataFrame) -> DataFrame:
    """part (lang), doc_id, leaf and seen of documents; where 3 divides crc32(doc_id), seen has the text's A-Z lower-cased.

    Only the columns doc_id, source, lang, n_chars and text count; a null in any of them is `-`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.sha2(encoded(*fields, F.col("text")), 256)
    seen = F.when(tampered, F.sha2(encoded(*fields, F.translate("text", UPPER, LOWER)), 256)).otherwise(leaf)
    return rows.select(F.col("lang").alias("part"), "doc_id", leaf.alias("leaf"), seen.alias("seen"))
