"""Vendor resolution. Registries are small dimension tables:

vendors(vendor_key, ord, official_name, numeric_locale, currency, exchange_rate), aliases(vendor_key, ord, alias),
columns(vendor_key, ord, field, header). Spark broadcasts them where they are below its threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import infer_field, squeeze, strip
from ..lineage import keep
from . import containment

STRUCTURE, INLINE = 0.80, 0.95
SUFFIX = r"(?i)\.(xlsx|xls|pdf|csv)"


def match_aliases(docs: DataFrame, vendors: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id and vendor_key of the first vendor (in registry order) one of whose aliases occurs in the text or filename.

    docs: doc_id, text, optionally filename. See containment: a join, whatever the size of the registry.
    """
    names = aliases.join(vendors.select("vendor_key", F.col("ord").alias("vendor_ord")), "vendor_key").select(F.struct(F.col("vendor_ord"), F.col("ord").alias("alias_ord"), F.col("vendor_key")).alias("rank"), squeeze(F.col("alias")).alias("name")).filter("name <> ''")
    # of equal names the first one holds
    names = keep(names.groupBy("name").agg(F.min("rank").alias("rank")).select(F.monotonically_increasing_id().alias("name_id"), "name", "rank"), "names")
    file = squeeze(F.col("filename")) if "filename" in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").alias("id"), F.concat_ws("\n", squeeze(F.col("text")), file).alias("text"))
    found = containment.occurrences(texts, names)
    return found.join(names.select("name_id", "rank"), "name_id").groupBy(F.col("id").alias("doc_id")).agg(F.min("rank").alias("rank")).select("doc_id", "rank.vendor_key")


def _spelling_scores(texts: DataFrame, spellings: DataFrame) -> DataFrame:
    """(x, y, s): 100 for equal spellings, 85 where one contains the other; texts: x, spellings: y."""
    named = lambda df, c: df.select(F.col(c).alias("name_id"), F.col(c).alias("name"))
    read = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text"))
    wide = containment.occurrences(read(texts, "x"), named(spellings, "y")).select(F.col("id").alias("x"), F.col("name_id").alias("y"))
    narrow = containment.occurrences(read(spellings, "y"), named(texts, "x")).select(F.col("name_id").alias("x"), F.col("id").alias("y"))
    return wide.unionByName(narrow).distinct().withColumn("s", F.when(F.col("x") == F.col("y"), 100).otherwise(85))


def match_structure(headers: DataFrame, vendors: DataFrame, columns: DataFrame, threshold: float = STRUCTURE) -> DataFrame:
    """doc_id, vendor_key, score of the best-fitting vendor (the first on ties) at the threshold or above.

    headers: doc_id, header (one row a cell). A vendor's score is the mean over its headers of the best cell's score: 1 for
    the same spelling, 0.85 where one contains the other, 0.6 for the same field (see header_score), in hundredths.

    Each distinct set of cells (layout) is scored once. Fields alone give each column 0.6 at most; so a vendor above that
    needs so many columns that are spelled alike, and one of those must be among its rarest spellings but for as many:
    these are the postings by which a layout finds vendors. Only vendors found are scored in full. Of the others, the one
    that fits a layout's set of fields best is known for each of the few such sets.
    """
    cells = headers.filter(F.trim("header") != "").select("doc_id", "header").distinct()
    layouts = cells.groupBy("doc_id").agg(F.sort_array(F.collect_set("header")).alias("cells"))
    layouts = keep(layouts, "layouts")
    distinct = keep(layouts.select("cells").distinct().withColumn("layout", F.monotonically_increasing_id()), "layouts")
    flat = keep(distinct.select("layout", F.explode("cells").alias("c")).select("layout", squeeze(strip(F.col("c"))).alias("x"), infer_field(F.col("c")).alias("field")).filter("x <> ''"), "layout-cells")
    known = keep(columns.select("vendor_key", "ord", squeeze(strip(F.col("header"))).alias("y"), infer_field(F.col("header")).alias("field")), "registered")
    sizes = known.groupBy("vendor_key").agg(F.count("*").alias("n"))
    alike = _spelling_scores(flat.select("x").distinct(), known.filter("y <> ''").select("y").distinct())
    hits = keep(flat.select("layout", "x").distinct().join(alike, "x").groupBy("layout", "y").agg(F.max("s").alias("s")), "spelled-alike")

    # how many columns must be spelled alike for a mean of the threshold, and the rarest spellings without all but one of them
    needed = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * (threshold - 0.6) / 0.4, 6))).cast("int")
    rarity = known.filter("y <> ''").groupBy("y").agg(F.count("*").alias("vendors"))
    rank = F.row_number().over(Window.partitionBy("vendor_key").orderBy("vendors", "y", "ord"))  # a vendor's own columns
    postings = known.join(rarity, "y").join(sizes, "vendor_key").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - needed + 1).select("y", "vendor_key").distinct()
    pairs = hits.join(postings, "y").select("layout", "vendor_key").distinct()

    # at most a set for each combination of fields
    masks = keep(flat.filter("field IS NOT NULL").groupBy("layout").agg(F.sort_array(F.collect_set("field")).alias("mask")), "masks")
    inside = F.coalesce(F.array_contains("mask", F.col("field")), F.lit(False)) & (F.col("y") != "")
    full = pairs.join(known, "vendor_key").join(hits, ["layout", "y"], "left").join(masks, "layout", "left")
    full = full.groupBy("layout", "vendor_key").agg(F.sum(F.greatest(F.coalesce("s", F.lit(0)), F.when(inside, 60).otherwise(0))).alias("total"))
    by_field = known.filter("field IS NOT NULL AND y <> ''").groupBy("vendor_key", "field").agg((F.count("*") * 60).alias("worth"))
    combos = masks.select("mask").distinct().select("mask", F.explode("mask").alias("field"))
    fields_only = by_field.join(F.broadcast(combos), "field").groupBy("mask", "vendor_key").agg(F.sum("worth").alias("total"))
    ranked = lambda df: df.join(sizes, "vendor_key").join(vendors.select("vendor_key", F.col("ord").alias("vendor_ord")), "vendor_key").withColumn("fit", F.struct(F.round(F.col("total") / (F.col("n") * 100), 9).alias("score"), (-F.col("vendor_ord")).alias("first"), "vendor_key"))
    best_of_fields = masks.join(ranked(fields_only).groupBy("mask").agg(F.max("fit").alias("fit")), "mask").select("layout", "fit")
    best = ranked(full).select("layout", "fit").unionByName(best_of_fields).groupBy("layout").agg(F.max("fit").alias("fit")).filter(F.col("fit.score") >= threshold)
    return layouts.join(distinct, "cells").join(best, "layout").select("doc_id", "fit.vendor_key", "fit.score")


def vendor_key(c: F.Column) -> F.Column:
    """A registry key of a vendor's file name."""
    bare = F.regexp_replace(c, SUFFIX, "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"\s+", "_")), r"[^a-z0-9_]", "")


def overlay(base: DataFrame, over: DataFrame, key: str = "vendor_key") -> DataFrame:
    """over's rows, and base's rows of keys that over lacks."""
    return over.unionByName(base.join(over.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


# --- fixed values: words that tell what a workbook's mapped header means, and how sure that is
WORKBOOK_TERMS = [
    ("transaction_date", 1.0, ["transaction date", "txn date", "posting date", "doc date", "value date", "booking date", "payment date", "due date", "date", "posting", "due"]),
    ("description", 1.0, ["document type", "doc type", "description", "particular", "detail", "text", "narrative", "memo", "remarks", "assignment"]),
    ("description", 0.35, ["reference", "reference key", "invoice", "document no", "invoice no"]),
    ("debit_amount", 1.0, ["debit", "withdrawal", "dr", "amount dr", "payments", "paid", "out"]),
    ("debit_amount", 0.75, ["amount", "amt", "sum", "value"]),
    ("credit_amount", 1.0, ["credit", "deposit", "cr", "amount cr", "receipts", "received", "refund", "in"]),
    ("credit_amount", 0.75, ["amount", "amt", "sum", "value"]),
    ("running_balance", 1.0, ["balance", "cum bal", "cum balance", "running balance", "bal", "closing", "outstanding"]),
]


def workbook_field(c: F.Column) -> F.Column:
    """(field, score) of a mapped header by its words; the first field wins ties; null below 0.5."""
    low = F.lower(F.trim(c))
    words = F.split(F.trim(F.regexp_replace(low, r"[^a-z0-9\s]", " ")), r"\s+")
    options = []
    for i, (field, score, terms) in enumerate(WORKBOOK_TERMS):
        single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
        hit = F.arrays_overlap(words, F.array(*map(F.lit, single)))
        for p in phrases:
            hit = hit | low.contains(p)
        options.append(F.when(hit, F.struct(F.lit(score).alias("score"), F.lit(-i).alias("rank"), F.lit(field).alias("field"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.when(best["score"] >= 0.5, F.struct(best["field"].alias("field"), best["score"].alias("score")))
