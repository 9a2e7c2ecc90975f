"""Ranked lexical search: MaxScore over an inverted index in shards of documents.

The index is a written table with a row a shard: its documents' ids and lengths, its terms in order,
and for each term the postings (document, occurrences) with the greatest occurrence count and the
least document length, from which a query knows the most that the term can give in the shard.

A query's terms are sorted by those upper bounds.  With the score to beat at hand (the tenth best so
far), the terms that cannot reach it even together are non-essential: only documents in an essential
list are looked at, and non-essential lists are probed for them from the largest bound down, while
what is left can still lift a document to that score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canticle.llm import kernels as K
from canticle.llm.blocks import squeeze, unsqueeze
from canticle.llm.storage import Scratch

#: Bytes of text in a shard; a longer document has a shard of its own.
SHARD_BYTES = 16 << 20
#: Terms of queries that are looked up at a time: what is broadcast is at most a few times eight bytes of each.
GROUP_TERMS = 400_000
#: The first of so many parts of the shards sets the scores that the other parts have to beat.
WAVES = 16
SHARD = "shard long, n_docs long, n_terms long, ids binary, known binary, lengths binary, terms binary, starts binary, most binary, least binary, docs binary, counts binary"


def term_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term of each text (ASCII letters folded) and term offsets per text."""
    return K.words(texts, K.IS_PUNCT)


def _texts(batches, size_of: int):
    """(ids, texts) of about so many bytes each, from batches (doc_id, text)."""
    ids, texts, held = [], [], 0
    for b in batches:
        _, off = K.buffer_of(b.column(1))
        for lo, hi in K.blocks(off, size_of):
            size = int(off[hi] - off[lo])
            if ids and held + size > size_of:
                yield pa.chunked_array(ids), pa.chunked_array(texts)
                ids, texts, held = [], [], 0
            ids.append(b.column(0).slice(lo, hi - lo))
            texts.append(b.column(1).slice(lo, hi - lo))
            held += size
    if ids:
        yield pa.chunked_array(ids), pa.chunked_array(texts)


def _index(shard_bytes: int):
    return lambda batches: _indexed(batches, shard_bytes)


def _indexed(batches, shard_bytes: int):
    for ids, texts in _texts(batches, shard_bytes):
        h, off = term_hashes(texts)
        lengths = np.diff(off)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        counts = np.diff(np.append(at, len(h))).astype(np.uint32)
        h, doc = h[at], doc[at]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        known = np.array(ids.is_valid())
        whole = np.array(ids.fill_null(0), np.int64)
        most = np.maximum.reduceat(counts, starts) if len(h) else counts
        least = np.minimum.reduceat(lengths[doc], starts).astype(np.uint32) if len(h) else counts
        parts = {"ids": whole, "known": known, "lengths": lengths.astype(np.int64), "terms": h[starts], "starts": np.append(starts, len(h)).astype(np.int64), "most": most, "least": least, "docs": doc, "counts": counts}
        number = int(K.mix(np.array([len(whole) + int(off[-1])], K.U) + K.mix(whole.view(K.U)[:1]))[0] >> K.U(1))
        yield pa.record_batch(
            {"shard": pa.array([number], pa.int64()), "n_docs": pa.array([int((lengths > 0).sum())], pa.int64()), "n_terms": pa.array([int(off[-1])], pa.int64())}
            | {name: pa.array([squeeze(x)], pa.binary()) for name, x in parts.items()}
        )


def build_index(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The inverted index of docs (doc_id, text), a row a shard, written to the shared folder.

    Every row is a document of its own, whatever its doc_id; rows without terms are in it with length 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.table(rows.mapInArrow(_index(SHARD_BYTES), SHARD), "index")


def _document_counts(vocabulary):
    def run(batches):
        total, sought = None, vocabulary.value
        for b in batches:
            total = np.zeros(len(sought), np.int64) if total is None else total
            for terms, starts in zip(b.column(0), b.column(1), strict=True):
                terms, starts = unsqueeze(terms.as_py(), K.U), unsqueeze(starts.as_py(), np.int64)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, sought), len(terms) - 1)
                    total += np.where(terms[at] == sought, starts[at + 1] - starts[at], 0)
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.record_batch({"term": sought[some].view(np.int64), "df": total[some]})

    return run


class Shard:
    """One row of the index, opened, with the given statistics of the whole collection."""

    def __init__(self, row: dict, n: int, length: int):
        def part(name, kind):
            return unsqueeze(row[name].as_py(), kind)

        self.ids, self.known, self.terms, self.starts = part("ids", np.int64), part("known", bool), part("terms", K.U), part("starts", np.int64)
        self.most, self.least = part("most", np.uint32).astype(np.int64), part("least", np.uint32).astype(np.int64)
        self.docs, self.counts = part("docs", np.uint32).astype(np.int64), part("counts", np.uint32).astype(np.int64)
        self.n, self.length = n, max(length, 1)
        self.norm = 8 * self.norms(part("lengths", np.int64))

    def norms(self, lengths):
        return 10 + (90 * lengths * self.n) // self.length

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """The most that an occurrence part of each term can be here: its greatest count in its shortest document."""
        tf = self.most[terms]
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.norms(self.least[terms]))

    def parts(self, term: int, at=slice(None)) -> np.ndarray:
        lo, hi = self.starts[term], self.starts[term + 1]
        tf = self.counts[lo:hi][at]
        return (1_000_000_000 * tf) // (1000 * tf + self.norm[self.docs[lo:hi][at]])

    def list(self, term: int) -> np.ndarray:
        return self.docs[self.starts[term] : self.starts[term + 1]]


def best(shard: Shard, terms: np.ndarray, weights: np.ndarray, beat: int, probed: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard (by place) with a score above 0 and of `beat` at least, and their scores.

    terms: places in the shard's term list.  probed collects the number of postings that were scored.
    """
    bound = weights * shard.bounds(terms)
    order = np.argsort(bound, kind="stable")
    terms, weights, total = terms[order], weights[order], np.cumsum(bound[order])
    split = int(np.searchsorted(total, beat, "left"))  # these together stay below `beat`
    none = np.zeros(0, np.int64)
    if split == len(terms):
        return none, none
    score = np.zeros(len(shard.ids), np.int64)
    for t, w in zip(terms[split:], weights[split:], strict=True):
        score[shard.list(t)] += w * shard.parts(t)
        if probed is not None:
            probed.append(len(shard.list(t)))
    found = np.flatnonzero(score)
    for i in range(split - 1, -1, -1):
        found = found[score[found] + total[i] >= beat]
        if not len(found):
            return none, none
        listed = shard.list(terms[i])
        at = np.searchsorted(listed, found)
        hit = at < len(listed)
        hit[hit] = listed[at[hit]] == found[hit]
        score[found[hit]] += weights[i] * shard.parts(terms[i], at[hit])
        if probed is not None:
            probed.append(int(hit.sum()))
    found = found[score[found] >= max(beat, 1)]
    return found, score[found]


def _search(queries, n: int, length: int, k: int):
    """Each task's k best documents of each query; the score to beat carries over from shard to shard."""

    def run(batches):
        vocabulary, weights, items, offsets, beat = queries.value
        beat = beat.copy()
        held: dict[int, tuple] = {}
        for b in batches:
            for i in range(len(b)):
                shard = Shard({name: b.column(name)[i] for name in b.schema.names}, n, length)
                if not len(shard.terms):
                    continue
                at = np.minimum(np.searchsorted(shard.terms, vocabulary), len(shard.terms) - 1)
                here = shard.terms[at] == vocabulary
                for q in range(len(offsets) - 1):
                    own = items[offsets[q] : offsets[q + 1]]
                    own = own[here[own]]
                    if not len(own):
                        continue
                    found, score = best(shard, at[own], weights[own], int(beat[q]))
                    if not len(found):
                        continue
                    ids, known = shard.ids[found], shard.known[found]
                    if q in held:
                        ids, known, score = (np.concatenate(x) for x in zip(held[q], (ids, known, score), strict=True))
                    order = np.lexsort((ids, ~known, -score))[:k]
                    held[q] = ids[order], known[order], score[order]
                    if len(order) == k:
                        beat[q] = max(beat[q], score[order[-1]])
        for q, (ids, known, score) in held.items():
            yield pa.record_batch({"query": np.full(len(ids), q, np.int64), "doc_id": pa.array(ids, pa.int64(), mask=~known), "score": score})

    return run


def _query_terms(batches):
    for b in batches:
        h, off = term_hashes(b.column(1))
        h, off = K.distinct(h, off)
        yield pa.record_batch({"query": np.repeat(np.array(b.column(0), np.int64), np.diff(off)), "term": h.view(np.int64)})


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of docs (doc_id, text) for each of items (item_id, text).

    Terms are runs of ASCII letters, digits and non-ASCII characters of the whole text, A-Z folded, known
    by 64-bit hashes.  A term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document scores the sum over
    the item's distinct terms of weight * (10^9 tf div (1000 tf + 8m)), m = 10 + (90 n N div L).

    * Every row of docs is a document of its own; a null doc_id ranks last among equal scores.  Null,
      empty and term-free texts are found by nothing and do not count in N.
    * Items of one item_id (null is one too) are one item with all their terms; an item without terms
      has no rows.  Scores of 0 are not returned.  Equal scores go by ascending doc_id.
    * Other columns are ignored.  An empty table on either side gives an empty result.
    * Items are worked on in groups of GROUP_TERMS terms, so what is broadcast and what a task holds is
      bounded by that, not by their number; an item is never cut, so one with more terms is alone.
    * The first of WAVES parts of the shards gives each item's k-th score so far; the other parts return
      only what reaches it, so what meets in the last step grows with WAVES and not with the shards.
    """
    scratch = Scratch(spark, "lexical")
    index = build_index(scratch, docs)
    n, length = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    named = items.select("item_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("\x00"))).alias("query"))
    terms = scratch.table(named.select("query", "text").mapInArrow(_query_terms, "query long, term long").distinct(), "query-terms")
    groups = max(1, math.ceil(terms.count() / GROUP_TERMS))
    results = []
    for g in range(groups):
        own = terms.where(F.pmod(F.xxhash64("query", F.lit(11)), F.lit(groups)) == g).toPandas()  # about GROUP_TERMS rows
        if not len(own) or not n:
            continue
        results.append(_ranked_group(spark, scratch, index, own, n, length, k))
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    names = named.select("query", "item_id").distinct()
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _ranked_group(spark: SparkSession, scratch: Scratch, index: DataFrame, own, n: int, length: int, k: int) -> DataFrame:
    """query, rank, doc_id and score for one bounded group of queries; own: their (query, term) rows."""
    queries, query = np.unique(own["query"].to_numpy(np.int64), return_inverse=True)
    vocabulary, term = np.unique(own["term"].to_numpy(np.int64).view(K.U), return_inverse=True)
    order = np.argsort(query, kind="stable")
    items, offsets = term[order], np.searchsorted(query[order], np.arange(len(queries) + 1))
    sought = spark.sparkContext.broadcast(vocabulary)
    counted = index.select("terms", "starts").mapInArrow(_document_counts(sought), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[np.searchsorted(vocabulary, counted["term"].to_numpy(np.int64).view(K.U))] = counted["df"].to_numpy(np.int64)
    weights = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    beat = np.zeros(len(queries), np.int64)
    wave = F.pmod(F.xxhash64("shard"), F.lit(WAVES)) == 0
    columns = [c for c in index.columns if c not in ("shard", "n_docs", "n_terms")]
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")

    def search(part: DataFrame, name: str) -> DataFrame:
        shared = spark.sparkContext.broadcast((vocabulary, weights, items, offsets, beat))
        rows = part.select(columns).mapInArrow(_search(shared, n, length, k), "query long, doc_id long, score long")
        return scratch.table(rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), name)

    first = search(index.where(wave), "first-wave")
    full = first.where(F.col("rank") == k).select("query", "score").toPandas()  # a row a query of the group at most
    beat[full["query"].to_numpy(np.int64)] = full["score"].to_numpy(np.int64)
    both = first.unionByName(search(index.where(~wave), "other-waves")).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table({"query": np.arange(len(queries)), "name": queries}))
    return both.join(F.broadcast(ids), "query").select(F.col("name").alias("query"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
