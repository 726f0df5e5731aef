"""Corrections of statements with amounts of any size; clashing column names in the store."""

import pytest
from ledgermill.operators import corrections, report, store
from ledgermill.plans import statement
from pyspark.sql import functions as F
from test_statements import grid


def sheet(opening, moves):
    rows = [["Bank of Tests"], [f"Opening Balance: {opening:.2f}"], ["Date", "Details", "Debit", "Credit", "Balance"]]
    balance = opening
    for day, m in enumerate(moves, 1):
        balance = round(balance + m, 2)
        rows.append([f"{day:02d}/06/2026", f"Move {day}", f"{-m:.2f}" if m < 0 else "", f"{m:.2f}" if m > 0 else "", f"{balance:.2f}"])
    return rows + [[f"Closing Balance: {balance:.2f}"]]


SIZES = {"small": 1_000.5, "tens of millions": 12_345_678.9, "billions": 1_000_000_000.05, "below zero": -98_765_432.1}


@pytest.mark.parametrize("name", list(SIZES))
def test_a_new_description_changes_no_amount(spark, name):
    s = statement.process(grid(spark, {name: sheet(SIZES[name], [-100.25, 20_000_000.5, -0.5])}))
    stored = corrections.Stored(s.statements, s.transactions, s.repairs, s.unparsed.withColumnRenamed("doc_id", "statement_id"))
    amounts = ["debit_amount", "credit_amount", "running_balance", "universal_debit", "universal_credit", "universal_balance", "status", "confidence"]
    before = [tuple(r) for r in s.transactions.orderBy("seq").select(*amounts).collect()]
    state = s.statements.select("confidence", "review_required", "anomaly_flags").first()
    done = corrections.correct(stored, spark.createDataFrame([(name, 0, "description", "noted")], "statement_id string, seq int, key string, value string"))
    assert [tuple(r) for r in done.transactions.orderBy("seq").select(*amounts).collect()] == before and len(before) == 3
    assert done.statements.select("confidence", "review_required", "anomaly_flags").first() == state
    assert done.transactions.orderBy("seq").first()["description"] == "noted"


def test_an_amount_of_millions_can_be_corrected(spark):
    rows = sheet(50_000_000.0, [-10_000_000.25, 20_000_000.5])
    rows[3][2], rows[3][4] = "1.00", "11.00"
    s = statement.process(grid(spark, {"d": rows}))
    stored = corrections.Stored(s.statements, s.transactions, s.repairs, s.unparsed.withColumnRenamed("doc_id", "statement_id"))
    fixes = [("d", 0, "debit_amount", "10000000.25"), ("d", 0, "running_balance", "39999999.75")]
    done = corrections.correct(stored, spark.createDataFrame(fixes, "statement_id string, seq int, key string, value string"))
    assert [(r["debit_amount"], r["running_balance"], r["status"]) for r in done.transactions.orderBy("seq").collect()] == [(10_000_000.25, 39_999_999.75, "clean"), (None, 60_000_000.25, "clean")]


def test_columns_of_any_name_in_the_store(spark):
    rows = spark.createDataFrame([(1, "a", "x", True, 5), (2, "b", None, False, 6)], "id long, v string, new_v string, has boolean, new int")
    out = store.apply_corrections(rows, spark.createDataFrame([(1, "c")], "id long, v string"), ["id"], ["v"]).orderBy("id")
    assert out.columns == rows.columns and [tuple(r) for r in out.collect()] == [(1, "c", "x", True, 5), (2, "b", None, False, 6)]
    flagged = store.flag_existing(rows, spark.createDataFrame([(2,)], "id long"), "id").orderBy("id")
    assert [(r["has"], r["flagged"]) for r in flagged.collect()] == [(True, False), (False, True)]


def test_report_sums_whole_cents_and_orders_repairs(spark):
    tx = spark.range(1000).select(F.lit("d").alias("statement_id"), F.col("id").cast("int").alias("seq"), F.lit(0.1).alias("debit_amount"), F.lit(None).cast("double").alias("credit_amount"))
    s = spark.createDataFrame([("d", 100.0, 0.0, 1.0, "USD", "b", "n", None, None, 1.0, False)], "statement_id string, opening double, closing double, rate double, original_currency string, bank_name string, account_number string, start_date string, end_date string, confidence double, review_required boolean")
    cells = [c for r in report.summary(s, tx).collect() for c in r["cells"]]
    assert "PASS" in cells and cells.count("100.00") >= 3
    log = [("d", 3, f, "1", "2", f"... in iteration {k}", 0.85) for f in ("running_balance", "debit_amount") for k in (2, 1)] + [("d", 4, "debit_amount", "1", "2", "... in iteration 1", 0.85)]
    repairs = spark.createDataFrame(log, "statement_id string, seq int, field string, raw_value string, corrected_value string, reason string, confidence double")
    none = spark.createDataFrame([], "statement_id string, page int, row int, raw_text string, reason string")
    rows = [r for r in report.audit_sheet(repairs, none).orderBy("ord").collect() if r["cells"][0].startswith("transactions")]
    assert len({r["ord"] for r in rows}) == 5
    assert [(r["cells"][0], r["cells"][3][-1]) for r in rows] == [("transactions[3].debit_amount", "1"), ("transactions[3].debit_amount", "2"), ("transactions[3].running_balance", "1"), ("transactions[3].running_balance", "2"), ("transactions[4].debit_amount", "1")]
