"""Reading and changing stored statements: lists, details, corrections, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import free_name

def statement_list(statements: DataFrame, columns: list[str], created: str, key: str) -> DataFrame:
    """The newest first; the key decides ties."""
    return statements.select(*columns).orderBy(F.desc(created), F.desc(key))


def latest(statements: DataFrame, created: str, key: str, n: int = 1) -> DataFrame:
    """The n newest rows."""
    return statements.orderBy(F.desc(created), F.desc(key)).limit(n)


def with_children(statements: DataFrame, children: DataFrame, key: str, order: list[str], name: str = "children") -> DataFrame:
    """Each statement with its child rows as an ordered array; statements without children keep an empty one."""
    first = [*order, *[c for c in children.columns if c != key and c not in order]]

    def compare(a: F.Column, b: F.Column) -> F.Column:  # by the order's columns alone: others may not be comparable
        x, y = (F.struct(*[r[c].alias(c) for c in order]) for r in (a, b))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*first)), compare).alias(name))
    return statements.join(nested, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))


def apply_corrections(rows: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the corrections' non-null values in their place; corrections has at most one row a key."""
    # the new values are one struct under a name that rows don't have
    name = free_name(rows, "new")
    new = corrections.select(*keys, F.struct(*columns).alias(name))
    return rows.join(new, keys, "left").select(*[F.coalesce(F.col(f"{name}.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def touched(statements: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Only the statements that corrections name: what has to be validated again."""
    return statements.join(corrections.select(key).distinct(), key, "left_semi")


def delete_where(rows: DataFrame, condition: F.Column) -> DataFrame:
    """rows without those that meet the condition (rows for which it is null stay)."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows whose statement is not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def flag_existing(statements: DataFrame, children: DataFrame, key: str, name: str = "flagged") -> DataFrame:
    """Whether each statement has a child row."""
    has = free_name(statements, "has")
    have = children.select(key).distinct().withColumn(has, F.lit(True))
    return statements.join(have, key, "left").withColumn(name, F.coalesce(has, F.lit(False))).drop(has)


def append(table: DataFrame, path: str, partition: str | None = None) -> None:
    """Adds rows to a stored table; columns it lacks are merged on reading."""
    w = table.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def upgrade(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """table with missing columns added as nulls of their types."""
    for c, kind in columns.items():
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast(kind))
    return table
