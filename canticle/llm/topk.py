"""Exact top-k by inner product: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canticle.llm.storage import Scratch

SCALE, K = 256, 5
#: Vectors of a candidate block and of a query block.
BLOCK, QUERIES = 2048, 1024
#: Tasks that share a query block, each with its own descending run of candidate blocks.
LANES = 8
#: The rotation is fitted on about so many vectors, chosen by a hash of vec_id; it only orders the work.
SAMPLE = 10000
VECTOR = "vec_id long, norm double, v binary, most long"
PACKED = "norm double, ids binary, vs binary, dim int"
#: Levels of length by which blocks and groups of queries find each other: a factor of 2^(1/LEVELS) a level.
LEVELS = 16
#: Shares of a level, so that vectors of one length are not one task's work.
SALTS = 32


def _integers(batches):
    """The vectors as integers, norms and largest component; null ids, null or non-finite components take no part."""
    for b in batches:
        lists = b.column(1).cast(pa.list_(pa.float64()))
        off = np.array(lists.offsets)
        flat = lists.values.slice(off[0], off[-1] - off[0])
        flat = np.where(np.array(flat.is_valid()), np.array(flat.fill_null(0.0)), np.nan) if len(flat) else np.zeros(0)
        off = off - off[0]
        fine = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = np.flatnonzero(np.array(b.column(0).is_valid()) & np.array(lists.is_valid()) & (fine[off[1:]] == fine[off[:-1]]))
        v = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0)).astype(np.int64)
        square = np.concatenate([[0.0], np.cumsum(v.astype(np.float64) ** 2)]) if len(good) and len(v) and float(np.abs(v).max()) ** 2 * len(v) < 2**52 else None
        vs = [v[off[i] : off[i + 1]] for i in good]
        norms = np.sqrt(square[off[good + 1]] - square[off[good]]) if square is not None else np.array([np.sqrt((x.astype(np.float64) ** 2).sum()) for x in vs], np.float64)
        most = np.array([np.abs(x).max(initial=0) for x in vs], np.int64)
        yield pa.record_batch({"vec_id": b.column(0).take(pa.array(good)), "norm": norms, "v": pa.array([x.tobytes() for x in vs], pa.binary()), "most": most})


def width(most: int) -> np.dtype:
    """The narrowest integers that hold components up to `most`."""
    return np.dtype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def matrix(blobs, dim: int) -> np.ndarray:
    """Rows of integers, shorter vectors continued with zeros."""
    out = np.zeros((len(blobs), dim), np.int64)
    for r, b in enumerate(blobs):
        v = np.frombuffer(b, np.int64)
        out[r, : len(v)] = v
    return out


def _pack(dim: int, size: int, kind: np.dtype):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                vs = matrix(part.column(2).to_pylist(), dim)
                yield pa.record_batch(
                    [pa.array([part.column(1)[0].as_py()], pa.float64()), pa.array([np.array(part.column(0), np.int64).tobytes()], pa.binary()), pa.array([vs.astype(kind).tobytes()], pa.binary()), pa.array([dim], pa.int32())],
                    ["norm", "ids", "vs", "dim"],
                )

    return run


def _dot(q: np.ndarray, c: np.ndarray, exact_in_double: bool) -> np.ndarray:
    if exact_in_double:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Best:
    """The k best (score, vec_id) of each query so far, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k, self.rotation = ids, q, k, rotation
        self.turned = q @ rotation
        self.rest = residuals(self.turned)
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.limit = floor.copy()
        self.row, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Offers a block of candidates, largest norm first."""
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
        slack = 1e-9 * (1 + self.norm * norm.max(initial=0))
        live = np.flatnonzero(self.norm * norm.max(initial=0) >= self.limit - slack)
        if not len(live):
            return
        turned = c @ self.rotation
        rest = residuals(turned)
        part, at = np.zeros((len(live), len(c))), 0
        alive = np.ones((len(live), len(c)), bool)
        for step, stop in enumerate(stops(c.shape[1])):
            part += self.turned[live, at:stop] @ turned[:, at:stop].T
            bound = part + np.outer(self.rest[live, step], rest[:, step])
            alive &= bound >= (self.limit[live] - slack[live])[:, None]
            at = stop
            if alive.mean() < 0.02:
                break
        i, j = np.nonzero(alive & (self.ids[live][:, None] != ids[None, :]))
        if not len(i):
            return
        if len(i) > 0.1 * alive.size:
            safe = float(self.norm.max(initial=0)) * float(norm.max(initial=0)) < 2**52
            score = _dot(self.q[live], c, safe)[i, j]
        else:
            score = (self.q[live[i]] * c[j]).sum(axis=1)
        hit = score >= self.limit[live[i]]
        self.merge(live[i][hit], score[hit], ids[j][hit])

    def merge(self, row, score, vec) -> None:
        row, score, vec = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.vec, vec])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        full = place == self.k - 1
        self.limit[row[full]] = np.maximum(self.limit[row[full]], score[full])
        self.row, self.score, self.vec = row[keep], score[keep], vec[keep]


def stops(dim: int) -> list[int]:
    """Rotated components summed before each bound is taken."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2)}) if dim else []


def residuals(turned: np.ndarray) -> np.ndarray:
    """Lengths of what is left of each vector behind each stop."""
    square = turned**2
    return np.stack([np.sqrt(square[:, s:].sum(axis=1)) for s in stops(turned.shape[1])], axis=1) if turned.shape[1] else np.zeros((len(turned), 0))


def _rotation(vectors: DataFrame, dim: int, n: int) -> np.ndarray:
    """The right singular vectors of a bounded sample, largest first."""
    some = vectors
    if n > SAMPLE:
        some = vectors.where(F.xxhash64("vec_id", F.lit(3)) < F.lit(-(1 << 63) + int((1 << 64) * (SAMPLE / n))))
    rows = matrix([bytes(r.v) for r in some.select("v").toLocalIterator()], dim).astype(np.float64)
    if not len(rows) or not dim:
        return np.eye(dim)
    return np.linalg.eigh(rows.T @ rows)[1][:, ::-1]


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates among all other rows.

    vectors: vec_id, embedding (array of numbers).  Components become floor(256 * x); the score is
    the integer inner product, ties go to the smaller vec_id.  Rows whose vec_id is null or whose
    vector is null or holds a null or non-finite component take no part.  Shorter vectors continue
    with zeros, so an empty vector scores 0.  Rows that repeat the query's vec_id are its own; a
    repeated query asks once, with its least vector; repeated candidates all count.
    Scores are exact within 64 bits.
    """
    scratch = Scratch(spark, "top-k")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    table = scratch.table(rows.mapInArrow(_integers, VECTOR), "vectors")
    n, dim, most = table.agg(F.count("*"), F.coalesce(F.max(F.length("v") / 8), F.lit(0)).cast("int"), F.coalesce(F.max("most"), F.lit(0))).first()
    kind = width(most)
    asked = table.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", F.col("x.norm").alias("norm"), F.col("x.v").alias("v"))
    q = asked.count()
    rotation = _rotation(table, dim, n)

    parts = max(1, math.ceil(n / (8 * BLOCK)))
    falling = table.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = scratch.table(falling.mapInArrow(_pack(dim, BLOCK, kind), PACKED).withColumn("block", F.monotonically_increasing_id()), "blocks")
    groups = max(1, math.ceil(q / QUERIES))
    dealt = asked.repartitionByRange(groups, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    asking = dealt.mapInArrow(_pack(dim, QUERIES, kind), PACKED).withColumn("group", F.monotonically_increasing_id())
    asking = scratch.table(asking.select("group", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), "queries")

    def floors(batches):
        """Each query's k-th best score within the block of the longest vectors: a floor for the rest."""
        for b in batches:
            out = []
            for ids, vs, c_ids, c_vs in zip(*(b.column(x).to_pylist() for x in ("q_ids", "q_vs", "ids", "vs")), strict=True):
                best = Best(*opened(ids, vs), rotation, np.full(len(ids) // 8, -math.inf), k)
                best.add(*opened(c_ids, c_vs))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(best.limit > 0, best.limit / best.norm, -math.inf)
                out.append((best.limit.tobytes(), float(need.min(initial=math.inf))))
            yield pa.record_batch([b.column("group"), b.column("q_ids"), b.column("q_vs"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.float64())], ["group", "q_ids", "q_vs", "floor", "need"])

    def opened(ids, vs):
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(vs, kind).astype(np.int64).reshape(len(ids), dim)

    def search(batches):
        best, now = None, None
        for b in batches:
            for g, lane, ids, vs, floor, c_ids, c_vs in zip(*(b.column(x).to_pylist() for x in ("group", "lane", "q_ids", "q_vs", "floor", "ids", "vs")), strict=True):
                if (g, lane) != now:
                    if best is not None:
                        yield found(best)
                    best, now = Best(*opened(ids, vs), rotation, np.frombuffer(floor, np.float64), k), (g, lane)
                best.add(*opened(c_ids, c_vs))
        if best is not None:
            yield found(best)

    def found(best: Best):
        return pa.record_batch({"query_id": best.ids[best.row], "vec_id": best.vec, "score": best.score})

    first = blocks.orderBy(F.desc("norm")).limit(1)
    # Floors: the query blocks meet one block, then each candidate block that can still matter.
    floored = asking.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one")
    floored = floored.mapInArrow(floors, "group long, q_ids binary, q_vs binary, floor binary, need double")
    floored = scratch.table(floored, "floors")
    # Which block meets which group is settled on norms alone, level by level of length, before any vector
    # moves; a group meets the levels that its floor leaves open.
    level = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1e-300))) * LEVELS).cast("long")
    lengths = blocks.select("block", "norm", level(F.col("norm")).alias("level"), F.pmod(F.xxhash64("block", F.lit(2)), F.lit(SALTS)).cast("long").alias("salt"))
    steps = F.broadcast(lengths.groupBy("level").agg(F.max("norm").alias("top")).agg(F.collect_list(F.struct("level", "top")).alias("steps")).withColumn("one", F.lit(1)))  # some thousand levels at most
    open_ = floored.select("group", (F.col("need") * (1 - 1e-9)).alias("need"), F.lit(1).alias("one")).join(steps, "one")
    open_ = open_.select("group", "need", F.explode(F.filter("steps", lambda s: s["top"] >= F.col("need"))["level"]).alias("level"))
    open_ = open_.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pairs = open_.join(lengths, ["level", "salt"]).where("norm >= need").select("group", "block")
    lane = F.pmod(F.xxhash64("block"), F.lit(LANES)).cast("int")
    met = pairs.join(blocks, "block").join(floored.drop("need"), "group").withColumn("lane", lane)
    met = met.repartition(max(1, groups * LANES), "group", "lane").sortWithinPartitions("group", "lane", F.desc("norm"))
    hits = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
