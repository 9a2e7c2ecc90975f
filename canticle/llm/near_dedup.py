"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm import kernels as K
from canticle.llm.graph import connected_components
from canticle.llm.storage import Scratch

#: Words of a shingle, and the least Jaccard similarity of a link in hundredths.
WORDS, SIMILARITY = 5, 85
#: Signature slots (a prime), of which BANDS * ROWS are used. At a similarity of 0.85 a pair
#: shares no band with probability (1 - 0.85^5)^26 = 2e-7.
SLOTS, BANDS, ROWS = 131, 26, 5
#: Shingles worked on at once within a batch.
BLOCK = 1 << 18
#: Bytes of text worked on at once within a batch.
PIECE = 2 << 20
#: Documents of a tile, and shingles of a membership matrix.
TILE, COLUMNS = 384, 2048
SKETCH = "row long, n_shingles long, k1 long, k2 long, bands array<long>"


def signatures(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, one row of SLOTS values per text; a text without shingles has all ones.

    Each element visits the slots in an order of its own, a permutation k -> a + b k of the field of
    SLOTS elements.  Those permutations are sharply 2-transitive, so two slots' ranks are distributed
    as under a uniform permutation: the same low variance as SuperMinHash.  Round j offers the value
    (j, random) to the j-th slot; a text stops when all its slots hold values of earlier rounds.
    """
    n = len(off) - 1
    sig = np.full((n, SLOTS), np.iinfo(np.uint64).max, K.U)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(off))
    slot = (s % K.U(SLOTS)).astype(np.int64)
    step = (K.mix(s + K.U(1)) % K.U(SLOTS - 1)).astype(np.int64) + 1
    for j in range(SLOTS):
        value = (K.mix(s + K.U(K.BASE * (j + 2) % (1 << 64))) >> K.U(8)) | K.U(j << 56)
        np.minimum.at(flat, doc * SLOTS + slot, value)
        at = np.unique(doc)
        unfinished = np.zeros(n, bool)
        unfinished[at] = sig[at].max(axis=1) >= K.U((j + 1) << 56) if j + 1 < SLOTS else False
        live = unfinished[doc]
        if not live.any():
            break
        s, doc, step = s[live], doc[live], step[live]
        slot = (slot[live] + step) % SLOTS
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    mult = K.mix(np.arange(1, ROWS + 1, dtype=K.U)) | K.U(1)
    rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    return K.mix((rows * mult).sum(axis=2, dtype=K.U) + K.mix(np.arange(BANDS, dtype=K.U) + K.U(77)))


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and offsets."""
    return K.distinct(*K.ngrams(*K.words(texts), WORDS))


def _parts(batch):
    """A batch (row, text) in slices of about PIECE bytes of text; a longer text is alone."""
    _, off = K.buffer_of(batch.column(1))
    for lo, hi in K.blocks(off, PIECE):
        yield batch.slice(lo, hi - lo)


def _sketch(batches):
    for batch in (part for b in batches for part in _parts(b)):
        s, off = shingle_sets(batch.column(1))
        total = [np.concatenate([[K.U(0)], np.cumsum(K.mix(s ^ K.U(c)), dtype=K.U)]) for c in (0x5BD1E995, 0x1B873593)]
        k1, k2 = (t[off[1:]] - t[off[:-1]] for t in total)
        keys = np.concatenate([np.zeros((0, BANDS), K.U), *(band_keys(signatures(s[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in K.blocks(off, BLOCK))])
        has = np.diff(off) > 0
        yield pa.record_batch(
            {
                "row": batch.column(0),
                "n_shingles": np.diff(off),
                "k1": k1.view(np.int64),
                "k2": k2.view(np.int64),
                "bands": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), keys[has].reshape(-1).view(np.int64)),
            }
        )


def _pack(batches):
    """The shingle hashes of each text, ascending: what a pair needs for its exact overlap."""
    for batch in (part for b in batches for part in _parts(b)):
        s, off = shingle_sets(batch.column(1))
        yield pa.record_batch({"id": batch.column(0), "bag": pa.array([s[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())})


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, K.U)


def _overlap(similarity: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = _unpack(x.as_py()), _unpack(y.as_py())
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= similarity * (len(both) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _square(similarity: int):
    return lambda square: _linked(square, similarity)


def _linked(square: pa.Table, similarity: int) -> pa.Table:
    """Links between documents of different components in a tile pair, by exact overlaps.

    Overlaps are counted with products of membership matrices, some thousand shingles at a time.
    """
    ids, part, own = (np.array(square[c]) for c in ("id", "part", "own"))
    bags = [_unpack(x.as_py()) for x in square["bag"]]
    across = square["a"][0].as_py() != square["b"][0].as_py()
    size = np.array([len(x) for x in bags])
    i, j = np.nonzero(np.triu(part[:, None] != part[None, :], 1))
    if across:
        i, j = (x[own[i] != own[j]] for x in (i, j))
    near = 100 * np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    if len(i) < 256:
        shared = np.array([len(np.intersect1d(bags[x], bags[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        values, column, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(bags)), size)
        common = count[column] > 1
        rank = np.cumsum(count > 1) - 1
        row, column = row[common], rank[column[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros(len(i), np.int64)
        overlap = np.zeros((len(bags), len(bags)), np.float32)
        edges = np.searchsorted(column, np.arange(0, int(column[-1]) + COLUMNS + 1 if len(column) else 1, COLUMNS))
        for k in range(len(edges) - 1):
            member = np.zeros((len(bags), COLUMNS), np.float32)
            member[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * COLUMNS] = 1
            overlap += member @ member.T
        shared = overlap[i, j].astype(np.int64)
    link = 100 * shared >= similarity * (size[i] + size[j] - shared)
    return pa.table({"u": np.minimum(ids[i], ids[j])[link], "v": np.maximum(ids[i], ids[j])[link]})


def _near_size(similarity: int, a: str, b: str) -> F.Column:
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _grouped(scratch: Scratch, rows: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row of a written table (row, doc_id, text) with its class, and (rep, component) of linked classes.

    Rows of equal sets are one class, known by its least row.  Classes are linked where their sets are
    similar enough or where rows of one doc_id belong to both.
    """
    sketch = scratch.table(rows.select("row", "text").mapInArrow(_sketch, SKETCH), "sketch")
    classes = sketch.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("row").alias("rep"))
    classed = sketch.select("row", "n_shingles", "k1", "k2").join(classes, ["k1", "k2", "n_shingles"], "left")
    classed = scratch.table(classed.select("row", "n_shingles", F.coalesce("rep", "row").alias("rep")), "classes")
    heads = sketch.join(classed.where("row = rep").select("row"), "row", "left_semi").where("n_shingles > 0")
    post = heads.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    member = F.struct("id", "n")
    centres = post.groupBy("bucket").agg(
        F.min(member).alias("c0"),
        *(F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", "n")).alias(f"c{i}") for i in (1, 2)),
        F.max("id").alias("most"),
    )
    centres = centres.where("c0.id < most").select("bucket", F.array("c0", F.struct("c1.id", "c1.n"), F.struct("c2.id", "c2.n")).alias("centre"))
    shared = scratch.table(post.join(centres, "bucket"), "shared-buckets")
    scratch.drop(sketch)

    # Full sets of the classes that share a bucket, packed once for all comparisons.
    ids = shared.select(F.col("id").alias("row")).distinct()
    bags = scratch.table(rows.select("row", "text").join(ids.hint("merge"), "row", "left_semi").mapInArrow(_pack, "id long, bag binary"), "bags")

    def ordered(df: DataFrame) -> DataFrame:
        return df.where(_near_size(similarity, "n", "m")).select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()

    spread = shared.select("id", "n", F.explode("centre").alias("c")).select("id", "n", F.col("c.id").alias("other"), F.col("c.n").alias("m"))
    first = scratch.table(ordered(spread.where("id != other")), "pairs")
    # A doc_id with rows of several classes links them, whatever their texts.
    owned = rows.select("row", "doc_id").where("doc_id is not null").join(classed, "row")
    least = owned.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u < most").select("doc_id", "u")
    own = owned.join(least, "doc_id").where("rep != u").select("u", F.col("rep").alias("v")).distinct()
    links = scratch.table(_verified(bags, first, similarity).unionByName(own), "links")
    parts = connected_components(links, scratch)

    # Buckets that still hold several components: compare what the centres have not connected.
    # Buckets of the same members (a pair can share many bands) are compared once.
    named = shared.select("bucket", "id", "n").join(parts, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("part"))
    named = scratch.table(named, "named")
    scratch.drop(shared, first)
    mixed = named.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members"), F.sum(F.xxhash64("id", F.lit(5)).cast("decimal(38,0)")).alias("mark"))
    mixed = mixed.where("lo < hi").groupBy("members", "mark").agg(F.min("bucket").alias("bucket"))
    # A large bucket is a square of tiles; a member goes to the tiles of its row and column.
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    place = F.pmod(F.xxhash64("id", F.lit(6)), F.col("tiles")).cast("int")
    left = named.join(mixed.select("bucket", tiles.alias("tiles")), "bucket").withColumn("own", place)
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "part")
    squares = left.join(bags, "id").groupBy("bucket", "a", "b")
    more = squares.applyInArrow(_square(similarity), "u long, v long").distinct()
    joined = scratch.table(parts.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), "links")
    scratch.drop(bags, named, links)
    return classed, connected_components(joined, scratch).select(F.col("id").alias("rep"), "component")


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs written once with a number a row, so that the number is the same in every later read."""
    return scratch.table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A ∩ B| >= similarity * |A ∪ B| over distinct five-word shingles
    (ASCII letters folded, words end at ASCII white space); a component is named by its least doc_id
    and keeps that document.

    * Rows of equal sets form one class first, so copies cost nothing further.  Classes meet in bands
      of SuperMinHash signatures.
    * In each band bucket three centres (the least row and two by hash) are compared with every
      member; only then, and only in buckets that still hold several components, are the remaining
      pairs of different components compared, tile by tile, and only links leave a tile.  Every pair
      that shares a bucket is thus either compared on full sets or already connected.  Sets are held
      as 64-bit hashes of their shingles.
    * Null, empty and blank texts have no shingles and are linked with nothing.
    * Rows that repeat a doc_id are one document, whatever their texts: what is linked to one of them
      is linked to all.  n_shingles is that of the row's own text.
    * A row with a null doc_id is a document of its own; it takes part in links, and its component_id
      is null, and kept true, where nothing that it reaches has a doc_id.
    * Texts of any length are worked through whole; one text is in memory at a time, with eight bytes a
      shingle.  Other columns of docs are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "near-dedup")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = _numbered(scratch, named)
    rows = numbered.withColumnRenamed("_row", "row")
    classed, parts = _grouped(scratch, rows, similarity)
    out = rows.select("row", "doc_id").join(classed, "row").join(parts, "rep", "left")
    # Empty texts of one doc_id share its document's component too; the name is the least doc_id of the component.
    out = scratch.table(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("part")), "parts")
    scratch.drop(numbered)
    names = out.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    big = names.where("size > 1").select("part", F.col("component_id").alias("_least"))
    out = out.join(big, "part", "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _verified(bags: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    a = bags.select(F.col("id").alias("u"), F.col("bag").alias("bag_u"))
    b = bags.select(F.col("id").alias("v"), F.col("bag").alias("bag_v"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "bag_u", "bag_v")
    return both.mapInArrow(_overlap(similarity), "u long, v long")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row of docs of each component; columns as they were.

    Each row is a document of its own here, whatever its doc_id: rows that repeat a doc_id, rows with
    a null one and a doc_id's different texts are judged by their texts.  A component keeps the row of
    least doc_id, a null one last, then of least text hash.  Texts without shingles all stay.
    """
    scratch = Scratch(spark, "near-dedup-rows")
    keyed = _numbered(scratch, docs)
    rows = keyed.select(F.col("_row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classed, parts = _grouped(scratch, rows, similarity)
    found = classed.where("n_shingles > 0").join(parts, "rep", "left").select(F.col("row").alias("_row"), F.coalesce("component", "rep").alias("_part"))
    named = keyed.select("_row", F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "_row")
    kept = found.join(named, "_row").groupBy("_part").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    gone = scratch.table(found.join(kept, "_row", "left_anti").select("_row"), "gone")
    return keyed.join(gone, "_row", "left_anti").select(docs.columns)
