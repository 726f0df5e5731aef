"""Report tables: invariants, ledgers with notes, totals, audit, flat tables with resolved columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of, headers_match_fuzzily
from ..lineage import once


def invariants(transactions: DataFrame, bounds: DataFrame) -> DataFrame:
    """statement_id, totals, calculated_closing, discrepancy and PASS or FAIL; in cents, always credit minus debit."""
    sums = transactions.groupBy("statement_id").agg(F.coalesce(F.sum("credit"), F.lit(0)).alias("total_credit"), F.coalesce(F.sum("debit"), F.lit(0)).alias("total_debit"))
    out = bounds.join(sums, "statement_id", "left").fillna(0, ["total_credit", "total_debit"])
    out = out.withColumn("calculated_closing", F.col("opening") + F.col("total_credit") - F.col("total_debit")).withColumn("discrepancy", F.col("calculated_closing") - F.col("closing"))
    return out.withColumn("check_status", F.when(F.abs("discrepancy") <= 1, "PASS").otherwise("FAIL"))


def ledger_note(status: Column, reason: Column | None = None) -> Column:
    """What the ledger's last column says."""
    fixed = F.concat(F.lit(K.NOTE_REPAIRED), F.coalesce(reason, F.lit(""))) if reason is not None else F.lit("Repaired")
    return F.when(status == "auto_repaired", fixed).when(status == "escalated", K.NOTE_ESCALATED).otherwise(K.NOTE_CLEAN)


def ledger_totals(transactions: DataFrame) -> DataFrame:
    """Sums of each statement and of all (statement_id null)."""
    return transactions.rollup("statement_id").agg(F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"), F.count("*").alias("n_rows"))


def combined_header(name: Column) -> Column:
    """Whether a target header such as 'Dr/Cr' stands for both sides."""
    parts = F.transform(F.split(F.lower(name), "/"), F.trim)
    side = lambda words: F.exists(parts, lambda p: any_of([p.contains(w) for w in words]))
    return name.contains("/") & side(("debit", "dr", "withdrawal")) & side(("credit", "cr", "deposit"))


#: What a target's own words say where no header does, in order; those of universal amounts first.
UNIVERSAL_WORDS = [(("debit", "withdrawal", "dr"), "universal_debit"), (("credit", "deposit", "cr"), "universal_credit"), (("bal",), "universal_balance"), (("amount", "sum", "val"), "universal_either")]
TARGET_WORDS = [
    (("date",), "transaction_date"), (("invoice", "desc", "particular", "detail"), "description"), (("debit", "withdrawal"), "debit_amount"), (("credit", "deposit"), "credit_amount"),
    (("bal",), "running_balance"), (("amount", "sum", "val"), "either"), (("status",), "status"), (("confidence",), "confidence"), (("note", "remark", "reason"), "reason"),
]


def _by_words(low: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    out = F.lit("")
    for words, source in reversed(rules):
        out = F.when(any_of([low.contains(w) for w in words]), F.lit(source)).otherwise(out)
    return out


def resolved(targets: DataFrame, info: DataFrame) -> DataFrame:
    """targets (statement_id, ..., target) with source: the transaction column that a target header shows.

    A field, 'either' (debit or credit), 'extra:<index>' or ''. info: statement_id, headers, mapping and optionally
    output_columns (target -> header). Tried in order: both sides of one header, a mapped header that resembles the
    target, any other header that does, the target's own words. One pass for all statements.
    """
    output = F.col("output_columns") if "output_columns" in info.columns else F.lit(None).cast("map<string,string>")
    known = targets.join(info.select("statement_id", F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), "mapping", output.alias("output_columns")), "statement_id", "left")
    known = known.withColumn("wanted", F.coalesce(F.nullif(F.try_element_at("output_columns", F.col("target")), F.lit("")), F.col("target")))
    known = once(known, same=F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: headers_match_fuzzily(h, F.col("wanted"))))
    fields = [F.when(F.coalesce(F.get("same", F.try_element_at("mapping", F.lit(f))), F.lit(False)), F.lit(f)) for f in K.FIELDS]
    other = F.array_position("same", True)
    low = F.lower(F.trim("target"))
    words = F.when(low.contains("universal"), _by_words(low, UNIVERSAL_WORDS)).otherwise(_by_words(low, TARGET_WORDS))
    source = F.when(combined_header(F.col("wanted")), "either").otherwise(F.coalesce(*fields, F.when(other > 0, F.concat(F.lit("extra:"), (other - 1).cast("string"))), words))
    return known.select(*targets.columns, source.alias("source"))


def flat_table(transactions: DataFrame, targets: list[str], output_columns: dict[str, str] | None = None, headers: list[str] | None = None, mapping: dict[str, int] | None = None) -> DataFrame:
    """One statement's transactions under its target headers; its headers are constants, so they are resolved first (one
    row a target), and the rows are a plain select."""
    spark = transactions.sparkSession
    info = spark.createDataFrame([(0, headers or [], mapping or {}, output_columns or {})], "statement_id int, headers array<string>, mapping map<string,int>, output_columns map<string,string>")
    named = spark.createDataFrame([(0, t) for t in targets], "statement_id int, target string")
    sources = {r["target"]: r["source"] for r in resolved(named, info).collect()}
    columns = []
    for t in targets:
        source = sources[t]
        if source.startswith("extra:"):
            c = F.coalesce(F.try_element_at("additional_fields", F.lit(source[6:])), F.lit(""))
        elif source == "either":
            c = F.coalesce("debit_amount", "credit_amount")
        elif source == "universal_either":
            c = F.coalesce("universal_debit", "universal_credit")
        else:
            c = F.col(source) if source in transactions.columns else F.lit("")
        columns.append(c.alias(t))
    return transactions.select("seq", *columns).orderBy("seq").drop("seq")


def audit_rows(repairs: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Repairs and unparsed lines as one audit table."""
    a = repairs.select("statement_id", F.lit("repair_attempt").alias("log_type"), F.col("raw_value").alias("raw_text"), "corrected_value", "reason", F.format_string("transactions[%d].%s", "seq", "field").alias("field_location"), F.lit(None).cast("int").alias("source_page"))
    b = unparsed.select("statement_id", F.lit("unparsed_line").alias("log_type"), "raw_text", F.lit(None).cast("string").alias("corrected_value"), "reason", F.lit(None).cast("string").alias("field_location"), F.col("page").alias("source_page"))
    return a.unionByName(b)
