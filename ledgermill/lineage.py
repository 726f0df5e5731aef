"""Cutting long plans: a result that several later steps read is written once to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "ledgermill-shared")
    return where.rstrip("/")


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table of the shared folder: later plans begin at its files, and read the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # read a few times at most: dictionaries of mostly different cells cost more than they save
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for held in _collectors.get():
        held.append(out)
    return out


#: The lists that tables are noted in while collecting() holds.
_collectors: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("collectors", default=())


@contextmanager
def collecting(held: list[DataFrame]) -> Iterator[None]:
    """Notes all tables that keep() writes meanwhile, by whichever function, so that they can be discarded together."""
    token = _collectors.set((*_collectors.get(), held))
    try:
        yield
    finally:
        _collectors.reset(token)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that keep() wrote, once nothing reads them any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "scratch_path", None)
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, whatever no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: as a generator's output they can't be copied into later filters,
    which would evaluate a long expression again wherever it is named."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
