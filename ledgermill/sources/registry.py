"""Vendor registries as dimension tables, from JSON or from a workbook's mapping sheet."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of
from ..operators.vendor import SUFFIX, vendor_key, workbook_field
from .grids import UNREADABLE, sheet_rows

VENDORS = "vendor_key string, ord int, official_name string, numeric_locale string, currency string, exchange_rate double"
ALIASES = "vendor_key string, ord int, alias string"
COLUMNS = "vendor_key string, ord int, field string, header string"
SHEET = "Final_mappings"


def from_dict(spark: SparkSession, registry: dict[str, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vendors, aliases and columns of {key: {official_name, aliases, columns, numeric_locale, currency, exchange_rate}}."""
    vendors = [(k, i, v.get("official_name"), v.get("numeric_locale"), v.get("currency"), float(v["exchange_rate"]) if v.get("exchange_rate") else None) for i, (k, v) in enumerate(registry.items())]
    aliases = [(k, i, a) for k, v in registry.items() for i, a in enumerate(v.get("aliases", []))]
    columns = [(k, i, f, h) for k, v in registry.items() for i, (f, h) in enumerate(v.get("columns", {}).items())]
    return spark.createDataFrame(vendors, VENDORS), spark.createDataFrame(aliases, ALIASES), spark.createDataFrame(columns, COLUMNS)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = spark.read.text(path, wholetext=True).first()[0]
    return from_dict(spark, json.loads(text))


# --- fixed values: words by which a mapped header serves a field that no exact term gave one, tried in this order
LOOSE_WORDS = {"transaction_date": ["date", "posting"], "description": ["description", "particular", "detail", "text", "narrative", "type", "assignment"]}
KEY_COLUMN, AMOUNT_WORD = "vendors", "amount"


def _workbook_rows(spark: SparkSession, content: bytes) -> DataFrame:
    """One row for each vendor and target header: ord, name, at, target, header; the key column is 'vendors', else the first."""
    rows = sheet_rows(content, SHEET)
    head = rows[0] if rows else []
    key_at = next((i for i, h in enumerate(head) if h.strip().lower() == KEY_COLUMN), 0)
    data = [(n, r[key_at], i, h, r[i]) for n, r in enumerate(rows[1:]) if r and r[key_at] for i, h in enumerate(head) if i != key_at and h]
    return spark.createDataFrame(data, "ord int, name string, at int, target string, header string")


def workbook_tables(spark: SparkSession, content: bytes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vendors (with output_columns: target -> header), aliases and columns of a workbook's mapping sheet.

    A header takes the field that its words name best, the last such header wins; one that names an amount serves the
    other side too, unless that has its own. Then looser words fill what is missing.
    """
    named = _workbook_rows(spark, content).withColumn("field", F.when(F.col("header") != "", workbook_field(F.col("header"))["field"]))
    order, low = F.col("at"), F.lower("header")
    last = lambda cond: F.max_by("header", F.when(cond, order))
    first = lambda cond: F.min_by("header", F.when(cond & (F.col("header") != ""), order))
    some = lambda cond: F.bool_or(F.coalesce(cond, F.lit(False)))
    direct = {f: F.when(some(F.col("field") == f), last(F.col("field") == f)) for f in K.FIELDS}
    loose = {f: any_of([low.contains(w) for w in words]) for f, words in LOOSE_WORDS.items()}
    by_vendor = named.groupBy("ord", "name").agg(
        *[c.alias(f) for f, c in direct.items()], *[F.when(some(c & (F.col("header") != "")), first(c)).alias(f"loose_{f}") for f, c in loose.items()],
        F.when(some(low.contains(AMOUNT_WORD)), first(low.contains(AMOUNT_WORD))).alias("amount"), F.collect_list(F.struct("at", "target", "header")).alias("shown"),
        F.when(some(F.col("field").isin("debit_amount", "credit_amount")), F.min_by("header", F.when(F.col("field").isin("debit_amount", "credit_amount"), order))).alias("first_amount"),
    )
    # of target headers of one name the last holds
    held = F.filter("shown", lambda x: ~F.exists("shown", lambda y: (y["target"] == x["target"]) & (y["at"] > x["at"])))
    by_vendor = by_vendor.withColumn("output_columns", F.map_from_entries(F.transform(held, lambda x: F.struct(x["target"].alias("key"), x["header"].alias("value")))))
    for f in LOOSE_WORDS:
        by_vendor = by_vendor.withColumn(f, F.coalesce(f, f"loose_{f}"))
    for f in ("debit_amount", "credit_amount"):
        by_vendor = by_vendor.withColumn(f, F.coalesce(f, "first_amount", "amount"))
    name = F.trim(F.regexp_replace("name", SUFFIX, ""))
    v = by_vendor.withColumn("official_name", name).withColumn("vendor_key", vendor_key(F.col("name")))
    # of rows with the same key the last one holds
    v = v.withColumn("rn", F.row_number().over(Window.partitionBy("vendor_key").orderBy(F.desc("ord")))).filter("rn = 1").drop("rn")
    vendors = v.select("vendor_key", "ord", "official_name", F.lit(None).cast("string").alias("numeric_locale"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("double").alias("exchange_rate"), "output_columns")
    aliases = v.select("vendor_key", F.posexplode(F.array("official_name", F.lower("official_name"), "name")).alias("ord", "alias"))
    columns = v.select("vendor_key", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("header")) for f in K.FIELDS])).alias("ord", "c")).select("vendor_key", "ord", "c.field", "c.header").filter("header IS NOT NULL")
    return vendors, aliases, columns


def workbook_registry(content: bytes) -> dict[str, dict]:
    """workbook_tables() as a dictionary: registries are small."""
    vendors, _, columns = workbook_tables(SparkSession.getActiveSession(), content)
    out = {r["vendor_key"]: {"official_name": r["official_name"], "columns": {}, "output_format_columns": dict(r["output_columns"])} for r in vendors.orderBy("ord").collect()}
    for r in columns.orderBy("vendor_key", "ord").collect():
        out[r["vendor_key"]]["columns"][r["field"]] = r["header"]
    return out


def overlaid(base: tuple[DataFrame, ...], over: tuple[DataFrame, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of which over's vendors take the place of base's of the same key."""
    keys = over[0].select("vendor_key").distinct()
    return tuple(o.unionByName(b.join(keys, "vendor_key", "left_anti"), allowMissingColumns=True) for b, o in zip(base, over, strict=True))


def read(spark: SparkSession, path: str | None = None, folders: tuple[str, ...] = (), default: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A registry: a given workbook alone (an absent one is an empty registry); else a given or the default JSON file, under
    the first workbook of the folders that has a mapping sheet."""
    empty = from_dict(spark, {})
    if path is not None and path.lower().endswith(".xlsx"):
        found = _first_workbook(spark, [path])
        return empty if found is None else workbook_tables(spark, found)
    base = read_json(spark, path or default) if path or default else empty
    found = _first_workbook(spark, [f"{f.rstrip('/')}/*.xlsx" for f in folders])
    return base if found is None else overlaid(base, workbook_tables(spark, found))


def _first_workbook(spark: SparkSession, globs: list[str]) -> bytes | None:
    """The first workbook with a mapping sheet, folder by folder and then by name."""
    for glob in globs:
        try:
            files = spark.read.format("binaryFile").load(glob)
        except AnalysisException:  # nothing there
            continue
        for name in [r["path"] for r in files.select("path").orderBy("path").collect()]:  # one name a workbook of a folder
            content = bytes(files.filter(F.col("path") == name).select("content").first()[0])
            try:
                if sheet_rows(content, SHEET):
                    return content
            except UNREADABLE:  # another kind of workbook
                continue
    return None


def store(registry: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """Takes the place of the registry stored under path."""
    for name, table in zip(("vendors", "aliases", "columns"), registry, strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("vendors", "aliases", "columns"))
