"""Sharding by size-tiered compaction over immutable Parquet shards and versioned manifests.

A store is a folder:

    data/v000001-<job>/...       shards that version 1 added; never changed
    manifests/v000001-<job>/     the manifest of that version as Parquet: one row a live shard
    versions/v000001             the commit: it names the manifest, and appears whole or not at all

Arrivals are appended as small shards.  Compaction puts shards into tiers by size, merges a tier's
runs once it holds FANIN of them into files of about the target size, and commits old minus merged
plus new as the next version.  A writer that loses the race for a version starts again from the
version that won; one that dies leaves no version behind.  Readers follow the largest version, so they see a whole version or none of it.
"""

from __future__ import annotations

import functools
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canticle.llm.storage import Scratch, filesystem

TARGET_BYTES, SMALLEST_BYTES = 32 << 20, 1 << 20
#: Shards of one tier differ in size by less than this factor; a tier is merged from FANIN shards on.
RATIO, FANIN = 4, 4
#: Bytes of values in a shard that arrives, and rows of it at most.
ARRIVAL_BYTES, ARRIVAL_ROWS = 16 << 20, 4096
MANIFEST = "path string, tier int, bytes long, rows long, version int"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanin: int = FANIN):
        self.spark, self.root, self.target, self.fanin = spark, root.rstrip("/"), target_bytes, fanin

    # Versions

    def _claims(self) -> dict[int, int]:
        """The version files, with their lengths."""
        fs, folder = filesystem(self.spark, f"{self.root}/versions")
        if not fs.exists(folder):
            return {}
        found = ((re.fullmatch(r"v(\d+)", f.getPath().getName()), f.getLen()) for f in fs.listStatus(folder))
        return {int(m[1]): n for m, n in found if m}

    def versions(self) -> list[int]:
        """The whole versions; an empty file, which only a writer of another kind can leave, is none."""
        return sorted(v for v, n in self._claims().items() if n)

    def latest(self) -> int:
        """The last whole version, 0 for an empty store."""
        return max(self.versions(), default=0)

    def _next(self) -> tuple[int, int]:
        """The last whole version, and the number of the next one: above every file there is."""
        claims = self._claims()
        return max((v for v, n in claims.items() if n), default=0), max(claims, default=0) + 1

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, tier, bytes, rows and version (that added it) of each live shard."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._name(version)}")

    def _name(self, version: int) -> str:
        fs, path = filesystem(self.spark, f"{self.root}/versions/v{version:06d}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, version: int, shards: DataFrame) -> None:
        """Writes the manifest, then a whole file that names it, then gives that the version's name; only one writer can.

        A writer that dies on the way leaves files that no version lists, and nothing to wait for.
        """
        name = f"v{version:06d}-{uuid.uuid4().hex}"
        try:
            shards.write.parquet(f"{self.root}/manifests/{name}")
        except Exception as e:
            # A vacuum may have ended the version that this one starts from; then another is the latest.
            if self.latest() >= version:
                raise Conflict(f"version {version - 1} is gone") from e
            raise
        fs, path = filesystem(self.spark, f"{self.root}/versions/v{version:06d}")
        _, whole = filesystem(self.spark, f"{self.root}/versions/.{name}")
        stream = fs.create(whole, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        if not self._published(fs, whole, path):
            fs.delete(whole, False)
            raise Conflict(f"version {version} exists")

    def _published(self, fs, whole, path) -> bool:
        """Gives a whole file its final name in one step, unless that is taken."""
        local = fs.getUri().getScheme() == "file"
        try:
            if local:  # a local rename would replace what is there; a link does not
                os.link(whole.toUri().getPath(), path.toUri().getPath())
                fs.delete(whole, False)
            else:
                jvm = self.spark._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(whole, path, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(path):
                return False
            raise

    def _written(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the shards in a folder, from file metadata and row counts."""
        fs, path = filesystem(self.spark, folder)
        if not fs.exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        files = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        per = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.floor(F.log(float(RATIO), F.greatest(F.col("bytes") / SMALLEST_BYTES, F.lit(1.0)))).cast("int")
        return per.select("path", tier.alias("tier"), "bytes", "rows", F.lit(version).alias("version"))

    # Writing

    def append(self, rows: DataFrame, rows_per_shard: int | None = None) -> int:
        """Adds rows as small shards and commits; returns the version.

        A shard takes so many rows as are about ARRIVAL_BYTES of values, if rows_per_shard does not say.
        """
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard or arrival_rows(rows)).parquet(folder)
        while True:
            base, version = self._next()
            try:
                self._commit(version, self.manifest(base).unionByName(self._written(folder, version)))
                return version
            except Conflict:
                continue

    def compact(self) -> int:
        """Merges full tiers until none is left; returns the version."""
        last = self.latest()
        while (version := self._merge_once()) is not None:
            last = version
        return last

    def plan(self, live: DataFrame) -> DataFrame:
        """path, bytes, rows and run (from 0, without gaps) of each shard to merge.

        Within a full tier, neighbours go into one run up to the target size.
        """
        small = live.where(F.col("bytes") < self.target / 2)
        tier = Window.partitionBy("tier")
        before = tier.orderBy("version", "path").rowsBetween(Window.unboundedPreceding, -1)
        small = small.withColumn("runs", F.count("*").over(tier)).withColumn("sum", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        small = small.where(F.col("runs") >= self.fanin).withColumn("part", F.floor(F.col("sum") / self.target))
        small = small.withColumn("members", F.count("*").over(Window.partitionBy("tier", "part"))).where("members > 1")
        return small.select("path", "bytes", "rows", (F.dense_rank().over(Window.orderBy("tier", "part")) - 1).cast("int").alias("run"))

    def _merge_once(self) -> int | None:
        """One round of merges and its commit; None if there is nothing to merge."""
        base, version = self._next()
        live = self.manifest(base)
        plan = self.plan(live).persist()
        try:
            runs = plan.agg(F.count_distinct("run").alias("n")).first()["n"]
            if not runs:
                return None
            paths = [r.path for r in plan.select("path").toLocalIterator()]
            source = self.spark.read.schema(self._schema(paths[0])).parquet(*paths)
            # The run of a row follows from its file; the plan has one row a small shard.
            run = unused("run", source.columns)
            which = plan.select(F.col("path").alias(f"{run}_path"), F.col("run").alias(run))
            rows = source.withColumn(f"{run}_path", F.col("_metadata.file_path")).join(which, f"{run}_path").drop(f"{run}_path")
            folder = f"{self.root}/data/m-{uuid.uuid4().hex}"
            # One run a partition, by its number, so a task writes one file of about the target size.
            rows.repartitionById(runs, run).drop(run).write.option("compression", "zstd").parquet(folder)
            merged = live.join(plan.select("path"), "path", "left_anti")
            try:
                self._commit(version, merged.select(*live.columns).unionByName(self._written(folder, version)))
            except Conflict:
                return self.latest()
            return version
        finally:
            plan.unpersist()

    def _schema(self, path: str):
        return self.spark.read.parquet(path).schema

    def vacuum(self) -> None:
        """Ends older versions: deletes the shards that only they list, their manifests and themselves.

        Files that no version lists are left alone, as a writer may be about to commit them.
        """
        have = self.versions()
        if len(have) < 2:
            return
        old = functools.reduce(DataFrame.union, (self.manifest(v).select("path") for v in have[:-1]))
        for row in old.distinct().join(self.manifest(have[-1]).select("path"), "path", "left_anti").toLocalIterator():
            fs, path = filesystem(self.spark, row.path)
            fs.delete(path, False)
        for v in have[:-1]:
            fs, manifest = filesystem(self.spark, f"{self.root}/manifests/{self._name(v)}")
            _, file = filesystem(self.spark, f"{self.root}/versions/v{v:06d}")
            fs.delete(file, False)
            fs.delete(manifest, True)

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest by default); an empty store has no columns to give."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            raise ValueError("the store holds no shard")
        return self.spark.read.schema(self._schema(paths[0])).parquet(*paths)


def arrival_rows(rows: DataFrame) -> int:
    """Rows that hold about ARRIVAL_BYTES of text and binary values, by the mean over all rows; ARRIVAL_ROWS at most."""
    wide = [F.octet_length(f"`{c}`") for c, kind in rows.dtypes if kind in ("string", "binary")]
    size = sum((F.coalesce(x, F.lit(0)) for x in wide), F.lit(0))
    mean = rows.agg(F.avg(size)).first()[0] or 0.0
    return max(1, min(ARRIVAL_ROWS, int(ARRIVAL_BYTES / max(1.0, mean))))


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns} | {c.lower() + "_path" for c in columns}:
        name = f"_{name}"
    return name


def shard(spark: SparkSession, docs: DataFrame, target_bytes: int = TARGET_BYTES, fanin: int = FANIN, rows_per_shard: int | None = None) -> DataFrame:
    """doc_id, shard, shard_rows, shard_bytes, version of each row of docs after append and compaction.

    The second arrival is every eighth doc_id by a hash.  shard numbers the live shards of the committed version from 1.  Rows are stored whole, with every
    column, nulls and repeats as they are; an empty table gives an empty store and an empty result.
    """
    store = ShardStore(spark, f"{Scratch(spark, 'shards').root}", target_bytes, fanin)
    late = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0
    rows_per_shard = rows_per_shard or arrival_rows(docs)
    store.append(docs.where(~late), rows_per_shard)
    store.append(docs.where(late), rows_per_shard)
    version = store.compact()
    manifest = store.manifest(version)
    numbered = manifest.select(F.col("path").alias("_path"), F.row_number().over(Window.orderBy("version", "path")).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    if manifest.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).crossJoin(numbered.drop("_path")).withColumn("version", F.lit(version)).limit(0)
    rows = store.read(version).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("_path"))
    return rows.join(numbered, "_path").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
