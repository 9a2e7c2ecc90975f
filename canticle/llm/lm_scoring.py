"""LM scoring by cross-entropy difference of a target and a background model.

Both are byte models of order 5 (four bytes of context) over one vocabulary, the 256 byte values and
an end mark, with the same additive smoothing:

    P(b | context) = (count(context, b) + ADD) / (count(context) + VOCABULARY * ADD)

The target is what `labels` marks, the background is all documents.  Counting: documents are packed
into blocks, a block sends its distinct five-byte strings with their counts to buckets of contexts,
and buckets answer with the two log-probabilities of each string, in the order asked.  Counts are
exact and nothing of the corpus passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import blocks as B
from canticle.llm import kernels as K
from canticle.llm.storage import Scratch

U = K.U
ORDER, ADD, VOCABULARY = 5, 0.1, 257
#: Fixed values, no bytes of UTF-8: what stands before a text, and its end.
BEFORE, END = 0xFF, 0xFE
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def codes(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte string that ends at each token, as a 40-bit number, and token offsets per text."""
    size = np.diff(block.off)
    start = block.off[:-1] + ORDER * np.arange(len(size))
    text = np.full(len(block.buf) + ORDER * len(size), BEFORE, np.uint8)
    text[np.repeat(start + ORDER - 1 - block.off[:-1], size) + np.arange(len(block.buf))] = block.buf
    text[start + ORDER - 1 + size] = END
    wide = np.zeros(max(0, len(text) - ORDER + 1), U)
    for i in range(ORDER):
        wide = (wide << U(8)) | text[i : len(text) - ORDER + 1 + i].astype(U)
    tokens = size + 1
    off = np.concatenate([[0], np.cumsum(tokens)])
    return wide[np.repeat(start - off[:-1], tokens) + np.arange(off[-1])], off


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.diff(np.append(new, len(code)))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a string's context."""
    return (K.mix((keys >> U(8)) + U(1)) % U(n)).astype(np.int64)


def asked(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings by bucket, then value; their counts and buckets."""
    keys, count = counted(code)
    bucket = bucket_of(keys, n)
    order = np.argsort(bucket, kind="stable")
    return keys[order], count[order], bucket[order]


def _ask(n: int):
    def run(batches):
        for batch in batches:
            for number, block in B.opened(batch):
                code, off = codes(block)
                keys, count, bucket = asked(code, n)
                target, hits = counted(code[np.repeat(block.tags == 1, np.diff(off))])
                at = np.searchsorted(target, keys)
                inside = np.zeros(len(keys), np.int64)
                if len(target):
                    found = target[np.minimum(at, len(target) - 1)] == keys
                    inside[found] = hits[at[found]]
                out = [(b, number, B.squeeze(keys[x:y]), B.squeeze(count[x:y]), B.squeeze(inside[x:y])) for b, x, y in B.dealt(bucket, n)]
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "counts", "inside"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    parts = [B.unsqueeze(x.as_py(), U) for x in group["keys"]]
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    logs = []
    for name in ("counts", "inside"):
        count = np.bincount(which, np.concatenate([B.unsqueeze(x.as_py(), np.int64) for x in group[name]]), len(keys))
        _, context = np.unique(keys >> U(8), return_inverse=True)
        whole = np.bincount(context, count)
        logs.append(np.log((count + ADD) / (whole[context] + VOCABULARY * ADD)).astype(np.float32)[which])
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    background, target = ([B.squeeze(x[edges[i] : edges[i + 1]]) for i in range(len(parts))] for x in logs)
    return pa.table({"block": group["block"], "bucket": group["bucket"], "background": background, "target": target})


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double"


def _score(n: int):
    def run(batches):
        for batch in batches:
            for (_, block), answers in zip(B.opened(batch), batch.column("answers").to_pylist(), strict=True):
                code, off = codes(block)
                keys, _, _ = asked(code, n)
                parts = sorted(answers, key=lambda x: x["bucket"])
                order = np.argsort(keys)
                at = np.searchsorted(keys[order], code)
                row = np.repeat(np.arange(len(off) - 1), np.diff(off))
                losses = []
                for name in ("target", "background"):
                    logs = np.concatenate([B.unsqueeze(x[name], np.float32) for x in parts])[order]
                    losses.append(-np.bincount(row, logs[at], len(off) - 1) / np.diff(off))
                ids = pa.array(block.ids, pa.int64(), mask=~block.known)
                yield pa.record_batch([ids, pa.array(np.diff(off)), pa.array(losses[0]), pa.array(losses[1]), pa.array(losses[0] - losses[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "loss_difference"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and loss_difference of each row of docs.

    docs: doc_id, text; labels: doc_id and a 0/1 label, 1 for the target.  Losses are nats a token;
    the difference is target minus background, so the lower it is the nearer a text is to the target.
    A null or empty text is its end mark alone.  Repeated rows count and score one by one; a doc_id
    labelled both ways is in the target; without a target its model is uniform.  Other columns are
    ignored.
    """
    scratch = Scratch(spark, "lm-scoring")
    target = labels.where(F.col(label).cast("int") == 1).select(F.col("doc_id").cast("long").alias("_id")).distinct().withColumn("_tag", F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(target.hint("merge"), rows["doc_id"] == target["_id"], "left").select("doc_id", "text", F.coalesce("_tag", F.lit(0)).cast("tinyint").alias("tag"))
    blocks = B.pack(scratch, rows, block_bytes)
    n = max(1, math.ceil((blocks.agg(F.sum("n_bytes")).first()[0] or 0) / BUCKET_BYTES))
    sent = blocks.mapInArrow(_ask(n), "bucket int, block long, keys binary, counts binary, inside binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket int, background binary, target binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "background", "target")).alias("answers"))
    return blocks.join(answers, "block").mapInArrow(_score(n), SCORES)
