"""What the corpus operators share: tokens, hashes, scratch tables, sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regex class and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Odd 64-bit multipliers of the mixers below.
M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "ledgermill-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def save_dealt(df: DataFrame, name: str, key: str, least: int = 1) -> DataFrame:
    """As save(), dealt to buckets by a key: later groupings by it read the buckets and shuffle only what they meet."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    # as many buckets as a shuffle has partitions, so that Spark does not prefer to shuffle anew
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), least))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that save() wrote, once nothing reads them any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "scratch_path", None)
        if getattr(df, "scratch_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df.scratch_table}")
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished jobs now, instead of at the driver's next collection."""
    gc.collect()
    tidy()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: what sizes of blocks, groups and key ranges follow. One aggregate over the text column."""
    return fields(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(size: int, mb: float, least: int = 1) -> int:
    """How many parts of about so many MB make up so many bytes."""
    return max(least, -(-size // int(mb * 1e6)))


def crc_of_id(col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, whatever no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, in this order: columns beside them, whatever their names, have no effect."""
    return df.select(*[F.col(f"`{n}`") for n in names])
