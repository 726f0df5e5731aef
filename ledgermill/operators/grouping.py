"""Rows of a page to records: wrapped rows, carried dates, footers, projection of fields.

A grid has doc_id, page, row, cells (array of strings); header maps have doc_id and mapping (field -> column index).
Records form by gaps and islands: a row with a date or an amount begins one, other rows continue it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import accepted_date, any_of, is_anchor, is_footer, strip
from ..lineage import keep, once
from .scan import Scan, numbered

PAGE = ["doc_id", "page"]


def cell(cells: Column, at: Column) -> Column:
    """A stripped cell; '' beyond the row's end or without a column."""
    return strip(F.coalesce(F.get(cells, at), F.lit("")))


def is_amount(c: Column) -> Column:
    """Whether a cell holds a number once other signs are gone: one point and one minus at most."""
    kept = F.regexp_replace(c, r"[^0-9.,\-]", "")
    many = lambda s: F.length(kept) - F.length(F.replace(kept, F.lit(s), F.lit("")))
    return (kept != "") & (many(".") <= 1) & (many("-") <= 1) & F.replace(kept, F.lit(","), F.lit("")).try_cast("double").isNotNull()


def body_text(cells: Column) -> Column:
    return strip(F.array_join(cells, " "))


def without_footers(grid: DataFrame) -> DataFrame:
    """Without empty rows and rows that are footers."""
    return once(grid, line=body_text(F.col("cells"))).filter((F.col("line") != "") & ~is_footer(F.col("line"))).drop("line")


def column_of(field: str) -> Column:
    """The column that mapping names for a field; null without one."""
    return F.get(F.map_values(F.map_filter("mapping", lambda k, v: k == field)), F.lit(0))


def columns_of(maps: DataFrame) -> DataFrame:
    """doc_id and what the steps on rows need of a mapping, looked up once a document: at_<field>, the columns that any
    field has (taken), and how many cells a row has at least."""
    taken = F.map_values("mapping")
    return maps.select("doc_id", *[column_of(f).alias(f"at_{f}") for f in K.FIELDS], taken.alias("taken"), (F.array_max(taken) + 1).alias("least"))


def at(field: str) -> Column:
    """The column of a field in rows that have columns_of()."""
    return F.col(f"at_{field}")


def _page_scan(**scans) -> Scan:
    return Scan(PAGE, ["row"], numbered(F.col("row")), **scans)


def _anchored(rows: DataFrame) -> DataFrame:
    """Adds anchor: the date column, else the mapped column with most non-empty cells of the page (the first such, in
    field order)."""
    date = at("transaction_date")
    counts = {f"filled_{f}": (cell(F.col("cells"), at(f)) != "").cast("int") for f in K.FIELDS}
    filled = [F.when(at(f).isNotNull(), F.struct((-F.col(f"filled_{f}")).alias("n"), F.lit(i).alias("ord"), at(f).alias("col"))) for i, f in enumerate(K.FIELDS)]
    undated = _page_scan(totals=counts).over(rows.filter(date.isNull())).withColumn("anchor", F.array_min(F.array(*filled))["col"])
    return rows.filter(date.isNotNull()).withColumn("anchor", date).unionByName(undated.drop(*counts))


def group_wrapped(grid: DataFrame, maps: DataFrame) -> DataFrame:
    """Records (doc_id, page, row of their first line, cells): descriptions are joined, other cells filled, dates carried.

    Rows before the first record of a page stay as they are; a record without a date takes the one before on its page.
    Records are numbered and dates carried by scans over segments of a page: a page of any length spreads over tasks.
    """
    rows = _anchored(grid.join(columns_of(maps).drop("taken"), "doc_id"))
    rows = rows.select("*", at("transaction_date").alias("date_col"), at("description").alias("desc_col"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.col("least") - F.size("cells"), F.lit(0))))
    rows = rows.withColumn("cells", F.transform(padded, lambda x: F.coalesce(x, F.lit(""))))
    own = cell(F.col("cells"), F.col("anchor"))
    dated = F.when(F.col("anchor").eqNullSafe(F.col("date_col")), is_anchor(own)).otherwise(own != "")
    begins = dated | any_of([F.coalesce(is_amount(cell(F.col("cells"), at(f))), F.lit(False)) for f in K.AMOUNT_FIELDS])
    rows = keep(rows.select(*PAGE, "row", "cells", "anchor", "date_col", "desc_col", begins.cast("int").alias("begins")), "lines")
    rows = _page_scan(sums={"record": F.col("begins")}).over(rows)
    rows = rows.withColumn("record", F.when(F.col("record") == 0, -1 - F.col("row")).otherwise(F.col("record")))
    lines = F.array_sort(F.collect_list(F.struct("row", "cells")))
    made = rows.groupBy(*PAGE, "record", "anchor", "date_col", "desc_col").agg(lines.alias("lines"))
    made = made.withColumn("head", F.get("lines", F.lit(0))["cells"]).withColumn("rest", F.slice("lines", F.lit(2), F.size("lines")))

    def merged(c: Column, i: Column) -> Column:
        more = F.filter(F.transform("rest", lambda r: cell(r["cells"], i)), lambda x: x != "")
        text = F.when(c == "", F.array_join(more, " ")).when(F.size(more) == 0, c).otherwise(F.concat(c, F.lit(" "), F.array_join(more, " ")))
        other = F.when(strip(c) != "", c).otherwise(F.coalesce(F.get(more, F.lit(0)), c))
        return F.when(i.eqNullSafe(F.col("desc_col")), text).when(i == F.col("anchor"), c).otherwise(other)

    joined = F.when(F.size("rest") == 0, F.col("head")).otherwise(F.transform("head", merged))  # most records are one row
    made = made.select(*PAGE, "record", "date_col", F.get("lines", F.lit(0))["row"].alias("row"), joined.alias("cells"))
    own_date = cell(F.col("cells"), F.col("date_col"))
    made = made.withColumn("own_date", own_date)
    # an orphan's empty cell stops the search for a date; a record's own empty cell does not
    carry = F.when(F.col("record") < 0, F.col("own_date")).otherwise(F.nullif("own_date", F.lit("")))
    made = _page_scan(carried={"last_date": carry}).over(keep(made, "lines"))
    made = made.withColumn("date", F.when(F.col("record") < 0, F.col("own_date")).otherwise(F.coalesce("last_date", F.lit(""))))
    dated = F.transform("cells", lambda c, i: F.when(i.eqNullSafe(F.col("date_col")) & (strip(c) == ""), F.col("date")).otherwise(c))
    return made.select(*PAGE, "row", F.when((F.col("own_date") == "") & (F.col("date") != ""), dated).otherwise(F.col("cells")).alias("cells"))


def project(records: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions with raw amounts and additional fields, and records whose date cannot be read (for review)."""
    rows = records.join(columns_of(maps), "doc_id").filter(at("transaction_date") < F.size("cells"))  # without a date column nothing is read
    rows = once(rows, transaction_date=accepted_date(F.col("cells"), at("transaction_date")))
    inside = lambda f: at(f) < F.size("cells")
    raw = lambda f, missing: F.when(inside(f), cell(F.col("cells"), at(f))).otherwise(F.lit(missing))
    extra = F.filter(F.transform("cells", lambda c, i: F.struct(i.cast("string").alias("key"), strip(c).alias("value"))), lambda e: ~F.array_contains("taken", e["key"].cast("int")))
    good = rows.filter("transaction_date IS NOT NULL").select(
        "doc_id", "page", "row", "transaction_date", raw("description", "").alias("description"), raw("debit_amount", "0.0").alias("debit_raw"),
        raw("credit_amount", "0.0").alias("credit_raw"), raw("running_balance", "0.0").alias("balance_raw"), F.map_from_entries(extra).alias("additional_fields"),
    )
    bad = rows.filter("transaction_date IS NULL").select("doc_id", "page", "row", body_text(F.col("cells")).alias("raw_text"), F.lit(K.NO_DATE).alias("reason"), F.lit(False).alias("review_required"))
    return good, bad
