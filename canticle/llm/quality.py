"""Quality classifier: a byte-level convolutional network in numpy.

Two banks of learned filters run over overlapping chunks that cover the whole document:

* byte filters over windows of WIDTH bytes, one every STRIDE bytes, on learned byte embeddings;
* self-similarity filters over chunks of 64 bytes, one every 32: their input is the share of a
  chunk's bytes that equal the byte d places before, for d = 1 .. LAGS.

Each filter is rectified and max-pooled over the document; a logistic unit combines the pools into
one probability.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import kernels as K
from canticle.llm.toxicity import labelled_sample

WIDTH, STRIDE, BYTE_FILTERS = 8, 4, 16
HALF, LAGS, LAG_FILTERS = 32, 24, 8
#: Never occurs in UTF-8: it fills the space behind each text.
PAD = 0xFF
#: Labelled rows that the network is fitted on, at most about so many, chosen by a hash of doc_id.
MAX_LABELLED = 3000
EPOCHS, BATCH, RATE, DECAY, SEED = 24, 32, 0.01, 1e-4, 7
#: Bytes worked on at once; a longer text is alone.
BLOCK = 1 << 20


def laid_out(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from multiples of HALF on, each followed by HALF pads at least; half-chunk offsets."""
    size = np.diff(off)
    halves = np.maximum(1, -(-size // HALF)) + 1
    start = np.concatenate([[0], np.cumsum(halves)])
    out = np.full(start[-1] * HALF, PAD, np.uint8)
    out[np.repeat(start[:-1] * HALF - off[:-1], size) + np.arange(len(buf))] = buf
    return out, start


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "table": r.normal(0, 0.15, (WIDTH, 256, BYTE_FILTERS)).astype(np.float32),
            "bias": np.zeros(BYTE_FILTERS, np.float32),
            "lags": r.normal(0, 0.3, (LAGS, LAG_FILTERS)).astype(np.float32),
            "lag_bias": np.zeros(LAG_FILTERS, np.float32),
            "out": r.normal(0, 0.3, BYTE_FILTERS + LAG_FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.p)
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(blob)) as f:
            net.p = {k: f[k] for k in f.files}
        return net

    def responses(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte windows and their responses, self-similarities of chunks and their responses."""
        padded = np.concatenate([text, np.full(2 * HALF, PAD, np.uint8)])
        n = len(text) // STRIDE
        cells = padded[: (n + WIDTH // STRIDE) * STRIDE].reshape(-1, STRIDE)
        h = np.broadcast_to(self.p["bias"], (n, BYTE_FILTERS)).copy()
        for j in range(WIDTH):
            h += self.p["table"][j][cells[j // STRIDE : j // STRIDE + n, j % STRIDE]]
        m = len(text) // HALF
        same = np.zeros((LAGS, m + 1), np.float32)
        real = padded != PAD
        for d in range(1, LAGS + 1):
            eq = np.zeros((m + 1) * HALF, np.uint8)
            eq[d : len(text)] = (text[d:] == text[:-d]) & real[d : len(text)]
            same[d - 1] = eq.reshape(-1, HALF).sum(axis=1)
        share = ((same[:, :-1] + same[:, 1:]) / (2 * HALF)).T
        g = share @ self.p["lags"] + self.p["lag_bias"]
        return cells, h, share, g

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        for a, b in K.blocks(off, BLOCK):
            text, start = laid_out(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            _, h, _, g = self.responses(text)
            # The last half of each text's space only ends its last chunk; it starts none.
            pools = np.concatenate([pooled(h, start, HALF // STRIDE), pooled(g, start, 1)], axis=1)
            out[a:b] = np.maximum(pools, 0) @ self.p["out"] + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    def fit(self, buf: np.ndarray, off: np.ndarray, labels: np.ndarray) -> Network:
        """Adam on the logistic loss; gradients reach only the window that won each pool."""
        r = np.random.default_rng(SEED + 1)
        mean, var, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(3))
        rate = max(0.02, min(0.98, float(labels.mean())))
        self.p["out_bias"][0] = np.log(rate / (1 - rate))
        t = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(labels))
            for lo in range(0, len(order), BATCH):
                grad = self._gradient(buf, off, labels, order[lo : lo + BATCH])
                t += 1
                lr = RATE * (1 - epoch / EPOCHS)
                for k, g in grad.items():
                    g = g + DECAY * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.98 * var[k] + 0.02 * g * g
                    self.p[k] -= (lr * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.98**t)) + 1e-6)).astype(np.float32)
        return self

    def _gradient(self, buf, off, labels, rows) -> dict[str, np.ndarray]:
        size = off[rows + 1] - off[rows]
        text, start = laid_out(np.concatenate([buf[off[i] : off[i + 1]] for i in rows]), np.concatenate([[0], np.cumsum(size)]))
        cells, h, share, g = self.responses(text)
        at_h, at_g = (np.stack([start[i] * k + x[start[i] * k : (start[i + 1] - 1) * k].argmax(axis=0) for i in range(len(rows))]) for x, k in ((h, HALF // STRIDE), (g, 1)))
        pool = np.concatenate([np.take_along_axis(h, at_h, 0), np.take_along_axis(g, at_g, 0)], axis=1)
        active = np.maximum(pool, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.p["out"] + self.p["out_bias"][0], -35, 35)))
        err = ((p - labels[rows]) / len(rows)).astype(np.float32)
        back = err[:, None] * self.p["out"] * (pool > 0)
        table = np.zeros_like(self.p["table"])
        filters = np.arange(BYTE_FILTERS)
        for j in range(WIDTH):
            np.add.at(table[j], (cells[at_h + j // STRIDE, j % STRIDE], filters), back[:, :BYTE_FILTERS])
        lags = np.einsum("rfl,rf->lf", share[at_g], back[:, BYTE_FILTERS:])
        return {
            "table": table, "bias": back[:, :BYTE_FILTERS].sum(0), "lags": lags, "lag_bias": back[:, BYTE_FILTERS:].sum(0),
            "out": err @ active, "out_bias": err.sum(keepdims=True),
        }


def pooled(x: np.ndarray, start: np.ndarray, each: int) -> np.ndarray:
    """Maxima over each text's rows of x, without those of its last half chunk."""
    edges = np.stack([start[:-1] * each, (start[1:] - 1) * each], axis=1).reshape(-1)
    return np.maximum.reduceat(x, edges, axis=0)[::2]


def _train(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("place", "ascending"), ("doc_id", "ascending")])
    buf, off = K.buffer_of(rows["text"])
    net = Network().fit(buf, off, np.array(rows["label"], np.float32))
    return pa.table({"network": [net.dump()]})


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = MAX_LABELLED) -> bytes | None:
    """The network learned from labels (doc_id, quality) on a bounded sample, whole texts; None without labelled rows."""
    rows, n = labelled_sample(docs, labels, "quality", F.lit(True) if use is None else use, most)
    found = rows.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(_train, "network binary").first() if n else None
    return bytes(found["network"]) if found else None


def score(spark: SparkSession, docs: DataFrame, network: bytes | None) -> DataFrame:
    """doc_id, score and predicted of each row of docs (doc_id, text).

    Null and empty texts score as a text of pads alone; repeated rows score alike; other columns are
    ignored.  Without a network (no labelled row) every score is 0.5.
    """

    def run(batches):
        net = Network.load(network) if network else None
        for b in batches:
            p = net.probabilities(*K.buffer_of(b.column(1))) if net else np.full(b.num_rows, 0.5)
            yield pa.record_batch({"doc_id": b.column(0), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
