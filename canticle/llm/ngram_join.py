"""N-gram Jaccard join: exact prefix lists with block skipping by position, answers derived from a similar set's.

Sets are ordered by one global order of shingles, rare ones first.  Two sets that are similar enough
share a shingle within short prefixes of that order, so only documents in one list, that of a prefix
shingle, can be linked.

* Index-level skipping: a list is blocks of equal set size, each in order of the shingle's position.
  Two blocks have one bound on the positions from which a pair can still be linked; the rest of both
  blocks is skipped unseen.
* Answer-level skipping: of one set, the pivot, the overlaps with all others of a list are computed,
  with what each lacks and has besides.  The overlap of two others follows from their small
  differences to the pivot; pairs that a bound on it settles are not looked at.

Only the components of the links are wanted, so copies are one class from the start, and pairs that are
connected already are left out.

Shingles are counted by exchange: documents' counted shingles are packed into blocks, a block sends its distinct
ones to buckets of hashes, and buckets answer with the numbers of sets.  A shingle so costs a few bytes on its way
there and fewer on its way back, and never a row of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from canticle.llm import blocks as B
from canticle.llm import kernels as K
from canticle.llm.graph import connected_components
from canticle.llm.near_dedup import _numbered, _parts, _unpack, _verified
from canticle.llm.storage import Scratch

#: Words of a shingle, and the least Jaccard similarity of a link in hundredths.
WORDS, SIMILARITY = 3, 90
#: One in so many shingles (by hash) is counted over all documents and comes first in the order.
SHARE = 4
#: Sets of a tile, and shingles of a membership matrix.
TILE, COLUMNS = 256, 2048
#: Pairs an entry, from which on a tile is worked through as a whole.
DENSE = 4
#: Counted shingles and documents of a block, and counted shingles of a bucket, about.
BLOCK, BUCKET = 1 << 19, 1 << 20
FACTS = pa.struct([(c, pa.int64()) for c in ("row", "n_shingles", "k1", "k2")])
SETS = "block long, facts array<struct<row:long,n_shingles:long,k1:long,k2:long>>, n_tokens long, have binary, tokens binary, more binary, rest binary"
#: 64-bit words of parities that are compared at once.
WORDS_AT_ONCE = 1 << 20


def prefix_length(n, similarity: int):
    """Leading shingles of a set of n of which a linked set must have one: n - ceil(n * similarity / 100) + 1."""
    return n * (100 - similarity) // 100 + 1


def needed(a, b, similarity: int):
    """The least overlap of linked sets of a and b shingles."""
    return -(-similarity * (a + b) // (100 + similarity))


def parities(s: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each set a map of bits, a power of two of them and about as many as members: each bit is the parity of
    the members that fall on it.  Folding a map's halves by exclusive-or gives the map of half the size."""
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        bits = max(64, 1 << int(b - a - 1).bit_length()) if b > a else 64
        odd = np.bincount((s[a:b] % K.U(bits)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(maps: list[bytes]) -> np.ndarray:
    """The maps as rows of 64-bit words, all of the least size among them."""
    least = min(len(m) for m in maps) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, least), axis=0) for m in maps])


def apart(maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the maps of each pair differ: the sets differ in so many members at least."""
    step = max(1, WORDS_AT_ONCE // maps.shape[1])
    parts = [np.bitwise_count(maps[i[k : k + step]] ^ maps[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _bound() -> int:
    """Hashes below it are of counted shingles."""
    return min((1 << 64) // SHARE, (1 << 64) - 1)


def _sets(similarity: int):
    """Blocks of sets: size and identity of each, counted shingles and, where those are too few for a prefix, the next ones in order."""
    bound = K.U(_bound())

    def worked(batch) -> tuple:
        s, off = K.distinct(*K.ngrams(*K.words(batch.column(1)), WORDS))
        k1, k2 = (np.diff(np.concatenate([[K.U(0)], np.cumsum(K.mix(s ^ K.U(c)), dtype=K.U)])[off].view(np.int64)) for c in (0x5BD1E995, 0x1B873593))
        n = np.diff(off)
        have = np.diff(np.concatenate([[0], np.cumsum(s < bound)])[off])  # a set is in order of hash, so these lead
        more = np.minimum(np.maximum(prefix_length(n, similarity) - have, 0), n - have)
        place = np.arange(len(s)) - np.repeat(off[:-1] + have, n)
        rest = (place >= 0) & (place < np.repeat(more, n))
        return np.array(batch.column(0), np.int64), n, k1, k2, have, s[s < bound], more, s[rest]

    def packed(number: int, parts: list[tuple]) -> pa.RecordBatch:
        *facts, have, tokens, more, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        facts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in facts], fields=list(FACTS))
        row = {"block": pa.array([number], pa.int64()), "facts": pa.ListArray.from_arrays(pa.array([0, len(have)], pa.int32()), facts)}
        return pa.record_batch(row | {"n_tokens": pa.array([len(tokens)], pa.int64())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in (("have", have), ("tokens", tokens), ("more", more), ("rest", rest))})

    def run(batches):
        task = TaskContext.get()
        number, parts, size = (task.partitionId() if task else 0) << 32, [], 0
        for part in (part for b in batches for part in _parts(b)):
            parts.append(worked(part))
            size += len(part) + len(parts[-1][5])
            if size >= BLOCK:
                yield packed(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield packed(number, parts)

    return run


def codes(tokens: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The leading width + 32 of a counted shingle's bits: its bucket, and 32 bits to tell it there from others."""
    return tokens >> K.U(max(0, bits - width - 32))


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.diff(np.append(new, len(code)))


def _ask(bits: int, width: int):
    def run(batches):
        for batch in batches:
            for number, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens"), strict=True):
                code, count = counted(codes(_unpack(tokens.as_py()), bits, width))
                out = [(b, B.squeeze(code[x:y].astype(np.uint32)), B.squeeze(count[x:y].astype(np.uint32))) for b, x, y in B.dealt((code >> K.U(32)).astype(np.int64), 1 << width)]
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                yield pa.record_batch([columns[0], pa.array([number] * len(out), pa.int64()), *columns[1:]], ["bucket", "block", "keys", "counts"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """The number of sets of each shingle that blocks ask for, in the order asked."""
    keys, counts = ([B.unsqueeze(x.as_py(), np.uint32) for x in group[c]] for c in ("keys", "counts"))
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(which, np.concatenate(counts)).astype(np.int64)[which]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    df = np.minimum(df, np.iinfo(np.uint32).max).astype(np.uint32)
    return pa.table({"block": group["block"], "bucket": group["bucket"], "df": pa.array([B.squeeze(df[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def leading(off: np.ndarray, tokens: np.ndarray, df: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, place) of each set's `most` first tokens by df, then hash, that another set has too."""
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((tokens, df, own))
    place = np.arange(len(tokens)) - off[own]
    keep = (place < most[own]) & (df[order] > 1)
    return own[keep], tokens[order][keep], place[keep]


def _prefixes(similarity: int, bits: int, width: int):
    """token, id, n and pos of the prefix shingles of a block's sets that stand for their class."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                block = {c: batch.column(c)[r] for c in batch.schema.names}
                facts = block["facts"].values
                rows, n = (np.array(facts.field(c), np.int64) for c in ("row", "n_shingles"))
                have, more = (np.frombuffer(block[c].as_py(), np.int64) for c in ("have", "more"))
                tokens, rest = _unpack(block["tokens"].as_py()), _unpack(block["rest"].as_py())
                df = np.zeros(0, np.int64)
                if len(tokens):
                    code = codes(tokens, bits, width)
                    answers = sorted(block["answers"].as_py(), key=lambda x: x["bucket"])
                    df = np.concatenate([B.unsqueeze(x["df"], np.uint32) for x in answers])[np.searchsorted(counted(code)[0], code)]
                lead, token, pos = leading(np.concatenate([[0], np.cumsum(have)]), tokens, df, prefix_length(n, similarity))
                tail = np.repeat(np.arange(len(n)), more)
                at = np.arange(len(rest)) - (np.cumsum(more) - more)[tail] + have[tail]
                own, token, pos = np.concatenate([lead, tail]), np.concatenate([token, rest]), np.concatenate([pos, at])
                keep = np.isin(rows, block["heads"].values.to_numpy())[own]
                own = own[keep]
                yield pa.record_batch([pa.array(x) for x in (token[keep].view(np.int64), rows[own], n[own], pos[keep])], ["token", "id", "n", "pos"])

    return run


def _bags(batches):
    for batch in (part for b in batches for part in _parts(b)):
        s, off = K.distinct(*K.ngrams(*K.words(batch.column(1)), WORDS))
        bags = [s[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.record_batch({"id": batch.column(0), "bag": pa.array(bags, pa.binary()), "parity": pa.array(parities(s, off), pa.binary())})


def candidates(n: np.ndarray, pos: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j by place) of a list's entries that sizes and positions leave, by block skipping.

    n: set sizes; pos: the list's shingle's place in each set.
    """
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    edges = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
    ends = np.append(edges[1:], len(n))
    sizes = n[edges]
    left, right = [], []
    for x, (lo, hi, a) in enumerate(zip(edges, ends, sizes, strict=True)):
        for y in range(x, int(np.searchsorted(sizes * similarity, 100 * a, "right"))):
            b, o = sizes[y], needed(a, sizes[y], similarity)
            i = lo + np.arange(np.searchsorted(pos[lo:hi], a - o, "right"))
            j = edges[y] + np.arange(np.searchsorted(pos[edges[y] : ends[y]], b - o, "right"))
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = i < j if x == y else slice(None)
            left.append(i[keep])
            right.append(j[keep])
    none = np.zeros(0, np.int64)
    return order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]


def gram(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share; (rows, values) are the sets' distinct members."""
    overlap = np.zeros((n, n), np.float32)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + COLUMNS + 1 if len(column) else 1, COLUMNS))
    for k in range(len(edges) - 1):
        member = np.zeros((n, COLUMNS), np.float32)
        member[rows[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * COLUMNS] = 1
        overlap += member @ member.T
    return overlap


def derived(bags: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs (i, j) of sets are linked, from their differences to one pivot.

    With a set's lack and surplus against the pivot x, |y ∩ z| is
    |x| - |lack y| - |lack z| + |lack y ∩ lack z| + |surplus y ∩ surplus z|.
    """
    size = np.array([len(b) for b in bags])
    pivot = bags[int(np.argsort(size, kind="stable")[len(size) // 2])]
    lacks = [np.setdiff1d(pivot, b, assume_unique=True) for b in bags]
    extra = [np.setdiff1d(b, pivot, assume_unique=True) for b in bags]
    lack, more = (np.array([len(x) for x in part]) for part in (lacks, extra))
    o = needed(size[i], size[j], similarity)
    base = len(pivot) - lack[i] - lack[j]
    most = base + np.minimum(lack[i], lack[j]) + np.minimum(more[i], more[j])
    link = base >= o
    open_ = (most >= o) & ~link
    if open_.any():
        some = np.unique(np.concatenate([i[open_], j[open_]]))
        place = np.zeros(len(bags), np.int64)
        place[some] = np.arange(len(some))
        total = np.zeros((len(some), len(some)), np.float32)
        for part in (lacks, extra):
            own = [part[k] for k in some]
            total += gram(np.repeat(np.arange(len(some)), [len(x) for x in own]), np.concatenate(own), len(some))
        link[open_] = base[open_] + total[place[i[open_]], place[j[open_]]].astype(np.int64) >= o[open_]
    return link


def _open_pairs(square: pa.Table, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that block skipping leaves and that are of different components; across tiles, one of each.

    Pairs whose maps of parities differ in more bits than linked sets may differ in members are out as well.
    """
    part, own, n, pos = (np.array(square[c]) for c in ("part", "own", "n", "pos"))
    i, j = candidates(n, pos, similarity)
    keep = part[i] != part[j]
    if square["a"][0].as_py() != square["b"][0].as_py():
        keep &= own[i] != own[j]
    i, j = i[keep], j[keep]
    if len(i):
        near = apart(folded(square["parity"].to_pylist()), i, j) <= n[i] + n[j] - 2 * needed(n[i], n[j], similarity)
        i, j = i[near], j[near]
    return i, j


def _met(similarity: int, dense: int = DENSE):
    """What is left of a tile: its few pairs themselves, or where they are many its entries that are in one.

    Pairs of all tiles are then taken once each, however many lists they share; entries bring their full
    sets to their tile once each, however many pairs they are in.
    """

    def run(square: pa.Table) -> pa.Table:
        i, j = _open_pairs(square, similarity)
        used = np.unique(np.concatenate([i, j]))
        ids = np.array(square["id"])
        if len(i) > dense * len(used):
            rows = square.take(pa.array(used))
            u = v = pa.nulls(len(rows), pa.int64())
        else:
            rows = square.slice(0, 1).take(pa.array(np.zeros(len(i), np.int64)))
            u, v = pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))
        return rows.append_column("u", u).append_column("v", v)

    return run


def _linked(similarity: int):
    def run(square: pa.Table) -> pa.Table:
        ids = np.array(square["id"])
        i, j = _open_pairs(square, similarity)
        if len(i):
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            bags = [_unpack(square["bag"][int(k)].as_py()) for k in used]
            link = derived(bags, place[: len(i)], place[len(i) :], similarity)
            i, j = i[link], j[link]
        return pa.table({"u": np.minimum(ids[i], ids[j]), "v": np.maximum(ids[i], ids[j])})

    return run


def _postings(scratch: Scratch, sets: DataFrame, classed: DataFrame, similarity: int) -> DataFrame:
    """token, id, n and pos of every prefix shingle that another row has too, of each class's least row.

    The order of shingles: the counted ones by number of rows, then hash; the others by hash.  A shingle of
    one row only meets nothing, but holds its place in the prefix.  Numbers are of the leading bits of a
    hash, so one may be too high, but is the same in every set.
    """
    bits = (_bound() - 1).bit_length()
    total = sets.agg(F.sum("n_tokens")).first()[0] or 0
    width = max(0, math.ceil(math.log2(max(1, total) / BUCKET)))
    sent = sets.select("block", "tokens").mapInArrow(_ask(bits, width), "bucket int, block long, keys binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket int, df binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "df")).alias("answers"))
    heads = classed.where("row = rep and n_shingles > 0").groupBy("block").agg(F.collect_list("row").alias("heads"))
    blocks = sets.join(heads, "block").join(answers, "block", "left")
    return scratch.table(blocks.mapInArrow(_prefixes(similarity, bits, width), "token long, id long, n long, pos long"), "postings")


def _lists(scratch: Scratch, postings: DataFrame, similarity: int) -> DataFrame:
    """token, band, id, n and pos: lists cut by set size, so that a hot shingle's list holds sets of like size only.

    Bands are as wide as sizes of linked sets may differ, so a pair is in one band or in two neighbours;
    every set is in its own band's list and, as a guest, in the next one.
    """
    step = -float(np.log(similarity / 100)) * (1 + 1e-9)  # a little wider, for rounding
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    rows = postings.withColumn("band", F.explode(F.array(band, band + 1)))
    many = rows.groupBy("token", "band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("token", "band")
    return scratch.table(rows.join(many, ["token", "band"]), "lists")


def _grouped(scratch: Scratch, rows: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """(row, n_shingles, rep) of each row of a written table (row, doc_id, text), and (rep, component) of linked classes."""
    sets = scratch.table(rows.select("row", "text").mapInArrow(_sets(similarity), SETS), "sets")
    facts = sets.select("block", F.inline("facts"))
    classes = facts.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("row").alias("rep"))
    classed = facts.join(classes, ["k1", "k2", "n_shingles"], "left")
    classed = scratch.table(classed.select("block", "row", "n_shingles", F.coalesce("rep", "row").alias("rep")), "classes")
    postings = _postings(scratch, sets, classed, similarity)
    scratch.drop(sets)
    lists = _lists(scratch, postings, similarity)
    scratch.drop(postings)
    bags = rows.select("row", "text").join(lists.select(F.col("id").alias("row")).distinct().hint("merge"), "row", "left_semi")
    bags = scratch.table(bags.mapInArrow(_bags, "id long, bag binary, parity binary"), "bags")

    # First each list's least set with all others that positions leave; what that links needs no more pairs.
    # A copy of the list's lead is joined, so no list is gathered.
    lead = lists.groupBy("token", "band").agg(F.min(F.struct("id", "n", "pos")).alias("lead"))
    first = lists.join(lead, ["token", "band"]).where("id != lead.id")
    o = F.ceil(similarity * (F.col("n") + F.col("lead.n")) / (100 + similarity) - 1e-9)
    close = (F.col("pos") <= F.col("n") - o) & (F.col("lead.pos") <= F.col("lead.n") - o)
    first = first.where(close).select(F.least("id", "lead.id").alias("u"), F.greatest("id", "lead.id").alias("v")).distinct()
    # A doc_id with rows of several classes links them, whatever their texts.
    owned = rows.select("row", "doc_id").where("doc_id is not null").join(classed, "row")
    least = owned.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u < most").select("doc_id", "u")
    same = owned.join(least, "doc_id").where("rep != u").select("u", F.col("rep").alias("v")).distinct()
    links = scratch.table(_verified(bags, first, similarity).unionByName(same), "links")
    parts = connected_components(links, scratch)

    # Lists of the same sets are one, each set at its least position, which holds for the shingle where a pair meets first.
    named = scratch.table(lists.join(parts, "id", "left").select("token", "band", "id", "n", "pos", F.coalesce("component", "id").alias("part")), "named")
    scratch.drop(lists)
    mark = F.sum(F.xxhash64("id", F.lit(5)).cast("decimal(38,0)"))
    mixed = named.groupBy("token", "band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members"), mark.alias("mark")).where("lo < hi")
    met = named.join(mixed.select("token", "band", "members", "mark"), ["token", "band"])
    met = met.groupBy("members", "mark", "id").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("part").alias("part"))
    met = met.join(bags.select("id", "parity"), "id")
    # A long list is a square of tiles; a set goes to the tiles of its row and column.
    met = met.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(6)), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("members", "mark", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "n", "pos", "part", "parity")
    met = scratch.table(met.groupBy("members", "mark", "a", "b").applyInArrow(_met(similarity), StructType([*met.schema, *(StructField(c, LongType()) for c in "uv")])), "met")
    few, many = met.where("u is not null").select("u", "v").distinct(), met.where("u is null").drop("u", "v")
    dense = many.join(bags.select("id", "bag"), "id").groupBy("members", "mark", "a", "b").applyInArrow(_linked(similarity), "u long, v long")
    more = _verified(bags, few, similarity).unionByName(dense).distinct()
    joined = scratch.table(parts.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more), "links")
    scratch.drop(bags, named, links, met)
    return classed, connected_components(joined, scratch).select(F.col("id").alias("rep"), "component")


def similar_groups(spark: SparkSession, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id and n_copies.

    Documents are linked when 100 * |A ∩ B| >= similarity * |A ∪ B| over distinct three-word shingles of the
    whole text (A-Z folded, words end at ASCII white space; with fewer words, the whole sequence is the
    one shingle).  Every link counts: candidates come from prefixes, which miss none, and are confirmed on
    full sets, held as 64-bit hashes.  component_id is the least doc_id that links reach, n_copies the
    number of rows of the same set.

    * Null, empty and blank texts have no shingles and are linked with nothing.
    * Rows that repeat a doc_id are one document, whatever their texts: what is linked to one of them is
      linked to all.  A row with a null doc_id takes part in links; its component_id is null where nothing
      that it reaches has a doc_id.
    * Texts of any length are worked through whole.  Other columns are ignored; an empty table gives an
      empty result.
    """
    scratch = Scratch(spark, "ngram-join")
    numbered = _numbered(scratch, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = numbered.withColumnRenamed("_row", "row")
    classed, parts = _grouped(scratch, rows, similarity)
    copies = classed.groupBy("rep").agg(F.count("*").alias("n_copies"))
    out = rows.select("row", "doc_id").join(classed, "row").join(parts, "rep", "left").join(copies, "rep")
    out = scratch.table(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("part"), "n_copies"), "parts")
    scratch.drop(numbered)
    names = out.groupBy("part").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").select("part", "least")
    out = out.join(names, "part", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "n_copies")
