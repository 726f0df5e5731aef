"""Prefix scans of groups of any size: no group has to fit in one task.

A group's rows are cut into segments along their order. Windows run within segments; each segment is summed up in one row
(sums, the last values, the number of rows), windows over these rows tell what lies before each segment, and that joins
the segment's rows again on the very keys by which they are already dealt. A group of a billion rows is ten thousand
segments, and its summaries ten thousand rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import free_name

#: Rows of a segment where rows of a group are numbered without large gaps.
SEGMENT = 100_000


def numbered(order: Column) -> Column:
    """The segment of a row that is numbered by a whole number in its group."""
    return F.floor(order / SEGMENT).cast("long")


@dataclass
class Scan:
    """What to scan: name of the result -> column that is scanned.

    sums: running sums, the row itself included; previous: the row before's value; carried: the last value that is not
    null, the row itself included; totals: sums over the whole group; position: name for the row's number, from 1 on.
    """

    keys: list[str]
    order: list[str]
    segment: Column
    sums: dict[str, Column] = field(default_factory=dict)
    previous: dict[str, Column] = field(default_factory=dict)
    carried: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    position: str | None = None

    def local(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows with their scans within segments, and the name of the segments' column."""
        name = free_name(rows, "segment")
        w = Window.partitionBy(*self.keys, name).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        scans = [F.sum(c).over(upto).alias(n) for n, c in self.sums.items()]
        scans += [F.lag(F.struct(c.alias("value"))).over(w).alias(n) for n, c in self.previous.items()]  # a struct: a null value is no lack of a row
        scans += [F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in self.carried.items()]
        if self.position is not None:
            scans.append(F.row_number().over(w).alias(self.position))
        return rows.withColumn(name, self.segment).select("*", *scans), name

    def summaries(self, rows: DataFrame, name: str, *more: Column) -> DataFrame:
        """A row for each segment: what lies before it, the whole group's totals, and further aggregates of the segment."""
        at = F.struct(*self.order)
        own = [F.sum(c).alias(f"sum_{n}") for n, c in self.sums.items()] + [F.sum(c).alias(f"all_{n}") for n, c in self.totals.items()]
        own += [F.max_by(F.struct(c.alias("value")), at).alias(f"last_{n}") for n, c in self.previous.items()]
        own += [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"held_{n}") for n, c in self.carried.items()]
        s = rows.groupBy(*self.keys, name).agg(F.count("*").alias("rows"), *own, *more)
        w = Window.partitionBy(*self.keys).orderBy(name)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        told = [F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in self.sums]
        told += [F.lag(f"last_{n}").over(w).alias(f"before_{n}") for n in self.previous]
        told += [F.last(f"held_{n}", ignorenulls=True).over(before).alias(f"before_{n}") for n in self.carried]
        told += [F.sum(f"all_{n}").over(Window.partitionBy(*self.keys)).alias(n) for n in self.totals]
        extra = [c for c in s.columns if c not in {*self.keys, name, "rows"} and not c.startswith(("sum_", "last_", "held_", "all_"))]
        return s.select(*self.keys, name, "rows", *extra, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before_rows"), *told)

    def joined(self, rows: DataFrame, name: str, summaries: DataFrame) -> DataFrame:
        """The rows with their scans over whole groups; further columns of the summaries come with them."""
        out = rows.join(summaries.drop("rows"), [*self.keys, name])
        for n in self.sums:
            out = out.withColumn(n, F.col(n) + F.col(f"before_{n}"))
        for n in self.previous:
            out = out.withColumn(n, F.coalesce(n, f"before_{n}")["value"])
        for n in self.carried:
            out = out.withColumn(n, F.coalesce(n, f"before_{n}"))
        if self.position is not None:
            out = out.withColumn(self.position, F.col(self.position) + F.col("before_rows"))
        return out.drop(name, "before_rows", *[f"before_{n}" for n in (*self.sums, *self.previous, *self.carried)])

    def over(self, rows: DataFrame) -> DataFrame:
        """rows with all scans."""
        scanned, name = self.local(rows)
        return self.joined(scanned, name, self.summaries(rows.withColumn(name, self.segment), name))
