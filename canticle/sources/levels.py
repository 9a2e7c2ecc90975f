"""Level envelopes of stems, kept in a store and worked out again only for stems that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canticle.sources.songfiles import publish, stored
from canticle.storage import Scratch, filesystem

#: Of the envelope's shape; a store of another version is worked out again.
VERSION, BINS_PER_SECOND = 1, 100
FACTS = ("version", "bins_per_second", "source_len", "source_mtime_unix")
SHAPE = "version int, bins_per_second int, source_len long, source_mtime_unix long, peaks array<int>"


def facts(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """key (the path), source_len and source_mtime_unix of the stems below a folder; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.where(F.lower("path").endswith(suffix)).select(F.col("path").alias("key"), F.col("length").alias("source_len"), F.unix_timestamp("modificationTime").alias("source_mtime_unix"))


def envelope(samples: DataFrame, per_bin: int) -> DataFrame:
    """key and peaks: the largest magnitude of every `per_bin` samples, of the stem's largest, in 255ths.

    samples: key, j (from 0), v.  Bins are folded map-side; a silent stem is all zeros, and only bins are gathered.
    """
    bins = samples.groupBy("key", F.floor(F.col("j") / per_bin).alias("bin")).agg(F.max(F.abs("v")).alias("peak"))
    rows = bins.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bin", "peak"))).alias("b"), F.max("peak").alias("top"))
    share = lambda x: F.when(F.col("top") > 0, F.floor(x["peak"] / F.col("top") * 255 + 0.5)).otherwise(0).cast("int")
    return rows.select("key", F.transform("b", share).alias("peaks"))


def known(spark: SparkSession, store: str) -> DataFrame:
    """key, the facts and peaks of every record that can be read; one that cannot counts as none."""
    fs, p = filesystem(spark, store)
    if not fs.exists(p):
        return spark.createDataFrame([], f"key string, {SHAPE}")
    rows = stored(spark, store).select("key", F.from_json("content", SHAPE).alias("r")).select("key", "r.*")
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*FACTS, "peaks")))


def stale(found: DataFrame, have: DataFrame) -> DataFrame:
    """Stems (key and the facts) that no record of the same facts answers for."""
    return found.join(have.select("key", *FACTS), ["key", *FACTS], "left_anti")


def refresh(spark: SparkSession, store: str, found: DataFrame, samples: DataFrame, per_bin: int, version: int = VERSION, rate: int = BINS_PER_SECOND) -> DataFrame:
    """Works out what is stale, publishes it as one version, and gives key, the facts and peaks of all stems found.

    found: key, source_len, source_mtime_unix; samples: key, j, v, read for stale stems alone.  A stem without
    samples (one that could not be decoded) gets no record, so the next run tries it again.  A run that dies
    leaves the store as it was.
    """
    found = found.select("key", F.lit(version).alias("version"), F.lit(rate).alias("bins_per_second"), F.col("source_len").cast("long").alias("source_len"), F.col("source_mtime_unix").cast("long").alias("source_mtime_unix"))
    old = Scratch(spark, "levels").table(stale(found, known(spark, store)), "stale")
    new = old.join(envelope(samples.join(old.select("key"), "key", "left_semi"), per_bin), "key")
    publish(new.select("key", F.to_json(F.struct(*FACTS, "peaks")).alias("content")), store)
    return found.join(known(spark, store), ["key", *FACTS]).select("key", *FACTS, "peaks")


def total(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0), lambda a, x: a + x)
