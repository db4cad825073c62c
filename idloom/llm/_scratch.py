"""Intermediate tables in the folder that all executors share, so that a lost executor costs a reread and not a rerun."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir.  Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(made := "file://" + tempfile.mkdtemp(prefix="idloom-"))
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def release() -> None:
    """Give what Python's and Arrow's allocators hold unused back to the system: the driver's memory is counted with its JVM's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Scratch:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def broadcast_within(df: DataFrame, rows: int, bytes_per_row: int, most: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if the counted rows fit in `most` bytes; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if rows * bytes_per_row <= most else df


def below(share: float, *columns: Column | str) -> Column:
    """True for that share of the rows, chosen by the hash of the columns: the same rows on every run."""
    return F.pmod(F.xxhash64(*columns, F.lit(7919)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
