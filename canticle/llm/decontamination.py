"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item's sketch is its shingles of least hash (a bottom-k MinHash).  Items are partitioned by size
into classes of doubling width; a class sets k so that a document holding the threshold's share of
an item's shingles must hold one of the sketch: of n shingles at most (1 - threshold) n can be
missing, so any floor((1 - threshold) n) + 1 of them meet the document.  Documents are looked up by
the sketches' hashes, whatever their length, and each candidate is verified on exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.llm.storage import Scratch

WORDS, THRESHOLD = 5, 0.8
SPACES = r"[\x20\x09-\x0D]+"
#: Sketch rows that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    """Lower-cased words between ASCII white space; a blank text is one empty word."""
    return F.split(F.btrim(F.lower(text.cast("string")), F.lit(" \t\n\x0b\x0c\r")), SPACES)


def starts(words: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))


def shingle_hashes(words: Column) -> Column:
    """A hash of each five words in a row; of all words where there are fewer."""
    return F.transform(starts(words), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WORDS))))


def shingles(words: Column) -> Column:
    """The distinct shingles themselves."""
    return F.array_distinct(F.transform(starts(words), lambda i: F.array_join(F.slice(words, i + 1, WORDS), " ")))


def key(doc_id: Column, text: Column) -> Column:
    """A document's or an item's identity: its id, or its text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.sha2(text.cast("string"), 256)))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_key, item_id, n_words, n and shingles of each item that has words."""
    rows = items.select("item_key", "item_id", word_array(F.col("text")).alias("words")).where(F.get("words", F.lit(0)) != "")
    return rows.select("item_key", "item_id", F.size("words").alias("n_words"), shingles(F.col("words")).alias("shingles")).withColumn("n", F.size("shingles"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item_key, n and h, the hashes of the sketch, k of them by the item's size class."""
    rows = items.select("item_key", word_array(F.col("text")).alias("words")).where(F.get("words", F.lit(0)) != "")
    rows = rows.select("item_key", F.array_sort(F.array_distinct(shingle_hashes(F.col("words")))).alias("hashes"))
    rows = rows.withColumn("n", F.size("hashes"))
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))
    k = F.floor(size_class * (1 - threshold) + 1e-9).cast("int") + 1
    return rows.select("item_key", "n", F.explode_outer(F.slice("hashes", F.lit(1), k)).alias("h"))


def windows(words: Column, n: int) -> Column:
    """Each n words in a row as one text; none where there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def window_hashes(words: Column, n: int) -> Column:
    """A hash of each n words in a row, as shingle_hashes has it for an item of n words."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))


def short_lengths(items: DataFrame, least: int) -> list[int]:
    """The lengths below five words and from `least` on that items have: four numbers at most."""
    size = F.size(word_array(F.col("text")))
    found = items.select(size.alias("n"), F.get(word_array(F.col("text")), F.lit(0)).alias("w")).where(F.col("w") != "").where(F.col("n").between(least, WORDS - 1))
    return sorted(r["n"] for r in found.select("n").distinct().collect())


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = WORDS) -> DataFrame:
    """key, doc_id, item_id, n_shared, n_shingles, n_words and containment of each leaked item; n_words is the item's length.

    docs: doc_id, text; items: item_id, text.  An item is in a document if the document has
    threshold * n of the item's n distinct shingles or more.  An item of fewer than five words is one
    shingle, its whole sequence; it is found anywhere in a document if it has `least` words or more, and
    otherwise only where it is a whole document.  Blank and null texts
    hold nothing and are in nothing.  A document without doc_id, or an item without item_id, is known by its text; rows that
    repeat a doc_id are one document, its best row counts.  Empty tables give an empty result.
    """
    scratch = Scratch(spark, "decontamination")
    items = items.select(key(F.col("item_id"), F.col("text")).alias("item_key"), "item_id", F.col("text").cast("string").alias("text"))
    sketch = scratch.table(sketches(items, threshold), "sketches")
    lengths = short_lengths(items, least)
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = texts.select(key(F.col("doc_id"), F.col("text")).alias("key"), word_array(F.col("text")).alias("words"))
    # explode_outer: explode would also filter on the array's size, which evaluates it twice.
    hashed = words.select("key", F.size("words").alias("length"), F.concat(shingle_hashes(F.col("words")), *(window_hashes(F.col("words"), n) for n in lengths)).alias("hashes"))
    hashed = hashed.select("key", F.greatest(F.col("length") - (WORDS - 1), F.lit(1)).alias("most"), F.explode_outer("hashes").alias("h"))
    found = hashed.join(sketch, "h").where(F.col("most") >= F.ceil(F.col("n") * threshold - 1e-9)).select("key", "item_key").distinct()
    found = scratch.table(found, "candidates")

    texts = texts.withColumn("key", key(F.col("doc_id"), F.col("text")))
    full = texts.join(found.select("key").distinct(), "key", "left_semi").select("key", "doc_id", word_array(F.col("text")).alias("words"))
    held = F.array_distinct(F.concat(shingles(F.col("words")), *(windows(F.col("words"), n) for n in lengths)))
    full = full.select("key", "doc_id", held.alias("held"))
    exact = full.join(found, "key").join(item_shingles(items), "item_key")
    exact = exact.select("key", "doc_id", "item_key", "item_id", "n_words", F.size(F.array_intersect("shingles", "held")).alias("n_shared"), F.col("n").alias("n_shingles"))
    exact = exact.where(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9)
    best = exact.groupBy("key", "doc_id", "item_key", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_words").cast("long").alias("n_words"))
    return best.drop("item_key").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def keep_unleaked(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = WORDS) -> DataFrame:
    """docs without the documents that hold an item; columns as they were.

    Items of fewer than `least` words take a document with them only where they are the whole of it.
    Rows with null, empty or blank texts stay; rows that repeat a doc_id go together if one of them
    holds an item, rows without a doc_id if their text does; other columns do not matter, whatever their names.
    """
    gone = leaks(spark, docs, items, threshold, least).select(F.col("key").alias("_gone")).distinct()
    return docs.join(gone, key(docs["doc_id"].cast("long"), docs["text"]) == gone["_gone"], "left_anti")
