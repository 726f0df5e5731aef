"""Corrections of stored statements: keys to fields, new values, and whole statements judged again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import convert, optional_amount, plain_number, to_units
from . import ledger, repair
from .export import resolved

EXTRA = "extra:"


@dataclass
class Stored:
    """Statements (statement_id, opening, closing, rate, headers, mapping, ...), their transactions, repairs and unparsed
    lines, as statement.process() returns them."""

    statements: DataFrame
    transactions: DataFrame
    repairs: DataFrame
    unparsed: DataFrame


def resolve(corrections: DataFrame, statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row for each corrected transaction: statement_id, seq, values (field -> new value) and extra (index -> value).

    corrections: statement_id, seq, key, value. A key is a field's own name, or a header: both sides of one header mean
    the side that the row has (the debit side if neither). Keys that mean nothing change nothing.
    """
    own = corrections.filter(F.col("key").isin(*K.FIELDS)).withColumn("source", F.col("key"))
    keys = corrections.filter(~F.col("key").isin(*K.FIELDS)).withColumnRenamed("key", "target")
    output = ["output_columns"] if "output_columns" in statements.columns else []
    named = resolved(keys, statements.select("statement_id", "headers", "mapping", *output)).withColumnRenamed("target", "key")
    found = own.unionByName(named).join(transactions.select("statement_id", "seq", "debit_amount", "credit_amount"), ["statement_id", "seq"])
    side = F.when(F.col("debit_amount").isNull() & F.col("credit_amount").isNotNull(), "credit_amount").otherwise("debit_amount")
    found = found.withColumn("source", F.when(F.col("source") == "either", side).otherwise(F.col("source")))
    is_extra, value = F.col("source").startswith(EXTRA), F.coalesce("value", F.lit(""))
    # a transaction's own keys are few; where two name one field, the last in their order holds
    held = lambda cond, name: F.map_from_entries(F.collect_list(F.when(cond, F.struct(name.alias("key"), F.col("value").alias("value")))))
    last = found.groupBy("statement_id", "seq", "source").agg(F.max_by(value, "key").alias("value"))
    return last.groupBy("statement_id", "seq").agg(held(F.col("source").isin(*K.FIELDS), F.col("source")).alias("values"), held(is_extra, F.substring("source", F.lit(len(EXTRA) + 1), F.length("source"))).alias("extra"))


def changed_rows(transactions: DataFrame, found: DataFrame) -> DataFrame:
    """The transactions of every statement that a correction names, with the new values in place."""
    rows = transactions.join(found.select("statement_id").distinct(), "statement_id", "left_semi").join(found, ["statement_id", "seq"], "left")
    new = lambda f: F.try_element_at("values", F.lit(f))
    amount = lambda f, empty: F.when(new(f).isNull(), F.col(f)).when(F.trim(new(f)) == "", F.lit(empty).cast("double")).otherwise(new(f).try_cast("double"))
    rows = rows.withColumn("transaction_date", F.coalesce(new("transaction_date"), "transaction_date")).withColumn("description", F.coalesce(new("description"), "description"))
    rows = rows.withColumn("debit_amount", amount("debit_amount", None)).withColumn("credit_amount", amount("credit_amount", None)).withColumn("running_balance", amount("running_balance", 0.0))
    extra = F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter("additional_fields", lambda k, v: ~F.map_contains_key(extra, k))
    return rows.withColumn("additional_fields", F.map_concat(kept, extra)).drop("values", "extra")


def correct(stored: Stored, corrections: DataFrame) -> Stored:
    """The stored tables after corrections: touched statements are validated, repaired and triaged anew, their repair logs
    replaced, confidence, review and flags set again; all other statements stay as they are."""
    found = resolve(corrections, stored.statements, stored.transactions)
    names = found.select("statement_id").distinct()
    show = lambda c: F.coalesce(plain_number(F.col(c)), F.lit(""))
    rows = changed_rows(stored.transactions, found)
    raw = rows.select("statement_id", "seq", "transaction_date", "description", "additional_fields", show("debit_amount").alias("debit_raw"), show("credit_amount").alias("credit_raw"), show("running_balance").alias("balance_raw"))
    mine = stored.statements.join(names, "statement_id", "left_semi")
    bounds = mine.select("statement_id", to_units(F.col("opening"), repair.SCALE).alias("opening"), to_units(F.col("closing"), repair.SCALE).alias("closing"))
    checked, log = repair.repaired(raw, bounds)
    judged = ledger.triage(checked, log).join(mine.select("statement_id", "rate"), "statement_id")
    judged = judged.select("*", optional_amount(F.col("debit_raw")).alias("debit_amount"), optional_amount(F.col("credit_raw")).alias("credit_amount"), (F.col("balance") / repair.SCALE).alias("running_balance"))
    money = lambda c: convert(F.col(c), F.col("rate"))
    new = judged.withColumn("status", F.col("triage")).withColumns({"universal_debit": money("debit_amount"), "universal_credit": money("credit_amount"), "universal_balance": money("running_balance")})
    transactions = stored.transactions.join(names, "statement_id", "left_anti").unionByName(new.select(*stored.transactions.columns))
    repairs = stored.repairs.join(names, "statement_id", "left_anti").unionByName(log.select(*stored.repairs.columns))
    lines = stored.unparsed.select("statement_id").distinct().withColumn("has_lines", F.lit(True))
    again = judged.groupBy("statement_id").agg(F.avg("confidence").alias("confidence"), F.bool_or(F.col("triage") == "escalated").alias("escalated"), *[F.first(c).alias(c) for c in ("opening", "closing", "total_credit", "total_debit", "credit_sign", "debit_sign")], F.count("*").alias("n_rows"))
    flags = ledger.closing_flag(again, repair.SCALE).select("statement_id", "flag")
    state = again.select("statement_id", F.col("confidence").alias("new_confidence"), "escalated").join(flags, "statement_id").join(lines, "statement_id", "left")
    s = stored.statements.join(state, "statement_id", "left")
    touched = F.col("escalated").isNotNull()
    s = s.withColumn("confidence", F.when(touched, F.col("new_confidence")).otherwise(F.col("confidence")))
    s = s.withColumn("review_required", F.when(touched, F.col("escalated") | F.coalesce("has_lines", F.lit(False))).otherwise(F.col("review_required")))
    s = s.withColumn("anomaly_flags", F.when(touched, F.array_compact(F.array("flag"))).otherwise(F.col("anomaly_flags")))
    return Stored(s.drop("new_confidence", "escalated", "flag", "has_lines"), transactions, repairs, stored.unparsed)
