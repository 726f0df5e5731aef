"""Report workbooks of statements as rows of sheets: invariants, ledger with totals, audit trail; flat tables and templates.

Rows are (doc_id, sheet, ord, cells): ord orders a sheet's rows, cells are strings. sources.grids.workbooks() makes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .export import resolved

#: Places of the blocks of a sheet; the rows of a block lie between.
HEAD, CHECK, LEDGER, TOTAL = 0, 1_000, 2_000, 1 << 40
REPAIRS, UNPARSED = 1_000, 1 << 40


def money(c: Column) -> Column:
    """Two decimals; '' for null."""
    return F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c.cast("double")))


def _block(first: int, rows: list[list[Column]]) -> Column:
    """A struct array (ord, cells) of rows that follow each other."""
    return F.array(*[F.struct(F.lit(first + i).cast("long").alias("ord"), F.array(*[c.cast("string") for c in r]).alias("cells")) for i, r in enumerate(rows)])


def detail(status: Column, raw: Column, corrected: Column, reason: Column) -> Column:
    """What the ledger says of a repaired or escalated row."""
    return F.when((status == "auto_repaired") & raw.isNotNull(), F.format_string(K.REPAIRED_DETAIL, raw, corrected, reason)).when(status == "escalated", K.ESCALATED_DETAIL).otherwise("")


def summary(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Metadata, invariants and totals of each statement as rows of its first sheet."""
    sums = transactions.groupBy("statement_id").agg(*[F.sum(F.round(F.col(f"{k}_amount") * 100).cast("long")).alias(k) for k in ("debit", "credit")])
    s = statements.join(sums, "statement_id", "left").fillna(0, ["debit", "credit"])
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    calculated = cents("opening") + F.col("credit") - F.col("debit")
    s = s.withColumn("calculated", calculated).withColumn("off", calculated - cents("closing"))
    period = F.concat_ws(" to ", F.coalesce("start_date", F.lit("")), F.coalesce("end_date", F.lit("")))
    facts = [F.col("bank_name"), F.col("account_number"), period, F.format_string("%.1f%%", F.col("confidence") * 100), F.when(F.col("review_required"), K.REVIEW_WORDS[0]).otherwise(K.REVIEW_WORDS[1])]
    values = [money(F.col("opening")), *[money(F.col(c) / 100) for c in ("credit", "debit", "calculated")], money(F.col("closing")), money(F.col("off") / 100), F.when(F.abs("off") <= 1, "PASS").otherwise("FAIL")]
    pairs = lambda labels, cells: [[F.lit(label), c] for label, c in zip(labels, cells, strict=True)]
    blocks = [
        _block(HEAD, pairs(K.METADATA_LABELS, facts)), F.when(F.col("rate") != 1.0, _block(HEAD + 100, pairs(K.RATE_LABELS, [F.col("original_currency"), F.lit("USD") if "universal" not in statements.columns else F.col("universal"), F.format_string("%.4f", "rate")]))).otherwise(F.array().cast("array<struct<ord:bigint,cells:array<string>>>")),
        _block(CHECK, [[F.lit(K.INVARIANT_TITLE)], *pairs(K.INVARIANT_LABELS, values)]), _block(LEDGER, [[F.lit(K.LEDGER_TITLE)], [F.lit(h) for h in K.LEDGER_HEADERS]]),
        _block(TOTAL, [[F.lit(K.TOTAL_TITLE), F.lit(""), money(F.col("debit") / 100), money(F.col("credit") / 100)]]),
    ]
    return s.select(F.col("statement_id").alias("doc_id"), F.lit(K.REPORT_SHEET).alias("sheet"), F.inline(F.concat(*blocks)))


def ledger_rows(transactions: DataFrame, repairs: DataFrame) -> DataFrame:
    """The transactions as rows of the first sheet."""
    last = repairs.groupBy("statement_id", "seq").agg(F.max_by(F.struct("raw_value", "corrected_value", "reason"), "reason").alias("r"))
    t = transactions.join(last, ["statement_id", "seq"], "left")
    cells = F.array(
        "transaction_date", "description", money(F.col("debit_amount")), money(F.col("credit_amount")), money(F.col("running_balance")), F.upper("status"),
        F.col("confidence").cast("string"), detail(F.col("status"), F.col("r.raw_value"), F.col("r.corrected_value"), F.col("r.reason")),
    )
    return t.select(F.col("statement_id").alias("doc_id"), F.lit(K.REPORT_SHEET).alias("sheet"), (F.lit(LEDGER + 2) + F.col("seq")).cast("long").alias("ord"), cells.alias("cells"))


def audit_sheet(repairs: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Repairs and unparsed lines as rows of the second sheet; statements without either have none."""
    # a row has three amounts, and each may be repaired in either round, which ends the reason
    place = F.col("seq").cast("long") * 8 + F.array_position(F.array(*map(F.lit, K.AMOUNT_FIELDS)), F.col("field")) * 2 + F.coalesce(F.regexp_extract("reason", r"(\d)$", 1).try_cast("int"), F.lit(0)) - 2
    r = repairs.select(F.col("statement_id").alias("doc_id"), (F.lit(REPAIRS + 2) + place).cast("long").alias("ord"), F.array(F.format_string("transactions[%d].%s", "seq", "field"), "raw_value", "corrected_value", "reason", F.col("confidence").cast("string")).alias("cells"))
    u = unparsed.select(F.col("statement_id").alias("doc_id"), (F.lit(UNPARSED + 2) + F.shiftleft(F.col("page").cast("long"), 24) + F.col("row")).alias("ord"), F.array("raw_text", F.col("page").cast("string"), "reason").alias("cells"))
    heads = []
    for rows, first, title, headers in ((r, REPAIRS, K.REPAIR_TITLE, K.REPAIR_HEADERS), (u, UNPARSED, K.UNPARSED_TITLE, K.UNPARSED_HEADERS)):
        heads.append(rows.select("doc_id").distinct().select("doc_id", F.inline(_block(first, [[F.lit(title)], [F.lit(h) for h in headers]]))))
    top = heads[0].select("doc_id").union(heads[1].select("doc_id")).distinct().select("doc_id", F.inline(_block(0, [[F.lit(K.AUDIT_TITLE)]])))
    every = top.unionByName(heads[0]).unionByName(r).unionByName(heads[1]).unionByName(u)
    return every.select("doc_id", F.lit(K.AUDIT_SHEET).alias("sheet"), "ord", "cells")


def report(statements: DataFrame, transactions: DataFrame, repairs: DataFrame, unparsed: DataFrame) -> DataFrame:
    """All rows of the workbooks of all statements."""
    return summary(statements, transactions).unionByName(ledger_rows(transactions, repairs)).unionByName(audit_sheet(repairs, unparsed))


def flat_rows(transactions: DataFrame, targets: DataFrame, info: DataFrame) -> DataFrame:
    """The transactions of many statements under their own target headers, as rows of a sheet.

    targets: statement_id, ord, target (also a template's first row); info: see export.resolved(). Headers are resolved
    once a statement; rows look their values up.
    """
    found = resolved(targets, info).groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct("ord", "target", "source"))).alias("columns"))
    head = found.select(F.col("statement_id").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.transform("columns", lambda c: c["target"]).alias("cells"))
    named = {c: F.col(c).cast("string") for c in ("transaction_date", "description", "status")}
    named |= {c: money(F.col(c)) for c in ("debit_amount", "credit_amount", "running_balance", "universal_debit", "universal_credit", "universal_balance")}
    named |= {"confidence": F.col("confidence").cast("string"), "either": money(F.coalesce("debit_amount", "credit_amount")), "universal_either": money(F.coalesce("universal_debit", "universal_credit"))}
    values = F.create_map(*[x for n, c in named.items() for x in (F.lit(n), c)])
    extra = F.transform_keys("additional_fields", lambda k, v: F.concat(F.lit("extra:"), k))
    rows = transactions.join(found, "statement_id").withColumn("values", F.map_concat(values, extra))
    cells = F.transform("columns", lambda c: F.coalesce(F.try_element_at("values", c["source"]), F.lit("")))
    return head.unionByName(rows.select(F.col("statement_id").alias("doc_id"), (F.col("seq") + 1).cast("long").alias("ord"), cells.alias("cells")))
