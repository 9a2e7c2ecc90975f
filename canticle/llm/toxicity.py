"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import kernels as K

#: Hashed features; the weights that are broadcast have at most this many entries.
BITS = 18
#: The learner reads at most about so many labelled rows, chosen by a hash of doc_id.
MAX_LABELLED = 16000
#: Rows of a learner; learners run side by side and their weights are averaged.
ROWS_PER_LEARNER = 2000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 5.0, 0.1, 4
BIAS = 1 << BITS
#: Bytes of a stem.
STEMS = (4, 6)
SEED = 20


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, their stems, pairs of neighbours and pairs with one word between, and the row of each.

    A stem is a word's first bytes, so that inflected forms share a feature.
    """
    buf, off = K.buffer_of(texts)
    buf = K.LOWER[buf]
    start, end, off = K.word_spans(buf, off, K.IS_PUNCT)
    w = K.span_hashes(buf, start, end)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    parts, at = [K.mix(w ^ K.U(1))], [rows]
    for size in STEMS:
        long = end - start > size
        parts.append(K.mix(K.span_hashes(buf, start[long], start[long] + size) ^ K.U(7 + size)))
        at.append(rows[long])
    for gap, salt in ((1, 3), (2, 5)):
        if len(w) > gap:
            same = rows[gap:] == rows[:-gap]
            parts.append(K.mix((w[:-gap] * K.U(K.BASE) + w[gap:]) ^ K.U(salt))[same])
            at.append(rows[gap:][same])
    return (np.concatenate(parts) >> K.U(64 - BITS)).astype(np.int64), np.concatenate(at)


def distinct(index: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | index)
    return both & (BIAS - 1), both >> BITS


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the last coordinate is an unregularised bias."""

    def __init__(self):
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == BIAS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g


def _learn(batch: pa.Table) -> pa.Table:
    """One learner over its rows, in the order of a hash: its non-zero weights and the bias."""
    order = np.argsort(np.array(batch["place"]), kind="stable")
    batch = batch.take(pa.array(order))
    index, row = distinct(*features(batch["text"]))
    ends = np.searchsorted(row, np.arange(len(batch) + 1))
    labels = batch["label"].to_pylist()
    model = Ftrl()
    for _ in range(EPOCHS):
        for r, label in enumerate(labels):
            model.learn(np.append(index[ends[r] : ends[r + 1]], BIAS), label)
    w = model.weights(np.arange(BIAS + 1))
    at = np.append(np.flatnonzero(w[:BIAS]), BIAS)
    return pa.table({"feature": at, "weight": w[at]})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int) -> tuple[DataFrame, int]:
    """doc_id, text, label and place of at most about `most` labelled rows, by a hash of doc_id; and their number.

    Rows without a doc_id or a 0/1 label are left out; a doc_id with both labels counts as 1.  Labels of
    documents that docs does not have do not count, so the bound thins what can be learned from only.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = known.where(use).withColumn("_place", F.xxhash64("_id", F.lit(SEED)))
    n = docs.select(F.col("doc_id").cast("long").alias("_id")).join(known, "_id").count()
    if n > most:
        known = known.where(F.col("_place") < F.lit(-(1 << 63) + int((1 << 64) * (most / n))))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(known, "_id").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_label").alias("label"), F.col("_place").alias("place"))
    return rows, min(n, most)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = MAX_LABELLED) -> np.ndarray:
    """Weights of the hashed features (BIAS last), learned from labels (doc_id, toxic).

    With no labelled row (no labels, null ones only, or none of a doc_id in docs) all weights are 0, so
    every score is 0.5; fit_known tells.
    """
    return fit_known(docs, labels, use, most)[0]


def fit_known(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = MAX_LABELLED) -> tuple[np.ndarray, bool]:
    """The weights of fit, and whether any labelled row was found in docs."""
    rows, n = labelled_sample(docs, labels, "toxic", F.lit(True) if use is None else use, most)
    learners = max(1, math.ceil(n / ROWS_PER_LEARNER))
    rows = rows.withColumn("learner", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(learners)))
    rows = rows.repartition(learners, "learner")
    parts = rows.groupBy("learner").applyInArrow(_learn, "feature long, weight double")
    found = parts.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("learners")).toPandas()  # at most BIAS + 1 rows
    weights = np.zeros(BIAS + 1)
    weights[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy(np.float64)
    ran = found["learners"][found["feature"] == BIAS].sum()  # a learner with rows always has a bias
    weights = (weights / max(1, ran)).astype(np.float32)
    return weights, len(found) > 0


def scores(texts, weights: np.ndarray) -> np.ndarray:
    """The probability of each text; a null text is an empty one."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    out = np.full(len(texts), float(weights[BIAS]))
    _, off = K.buffer_of(texts)
    for a, b in K.blocks(off, 1 << 21):
        index, row = features(texts.slice(a, b - a))
        some = weights[index] != 0
        index, row = distinct(index[some], row[some])
        out[a:b] += np.bincount(row, weights[index], minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(spark: SparkSession, docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score and predicted of each row of docs (doc_id, text).

    Empty, blank and null texts score as texts without words do; repeated rows score alike; other
    columns are ignored.  The weights are a broadcast of 4 * (2^18 + 1) bytes.
    """
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            p = scores(b.column(1), w)
            yield pa.record_batch({"doc_id": b.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, use: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; columns as they were.

    All rows are kept where no labelled row was found in docs: nothing is known to be toxic then.
    """
    weights, known = fit_known(docs, labels, use)
    if not known:
        return docs
    shared = spark.sparkContext.broadcast(weights)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column(place), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
