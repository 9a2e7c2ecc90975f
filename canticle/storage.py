"""Where intermediate tables live: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from canticle.shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, a local session gets one; a cluster has to name it."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="canticle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path of a path, so that any store that Spark writes to will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def large(rows: DataFrame) -> DataFrame:
    """Rows that grow with the input: their files are compressed, so Spark takes them for small and would broadcast them by way of the driver."""
    return rows.hint("merge")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/canticle/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.read(path, df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            fs, p = filesystem(self.spark, t._scratch_path)
            fs.delete(p, True)
