"""Golden values of the text functions."""

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import text as T


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("v")).collect()]


@pytest.mark.parametrize(
    ("locale", "cases"),
    [
        ("period_decimal", {"1,234.56": 1234.56, "(1,020.98)": -1020.98, "(-100.00)": -100.0, "$120.50": 120.5, "": 0.0, None: 0.0, "12/05/2024": 0.0, "2024-01-02": 0.0, "1.2.3": 0.0, "-5": -5.0, "abc": 0.0, "12O.50": 12.5, "\t7.5 ": 7.5, ".": 0.0}),
        ("comma_decimal", {"1.234,56": 1234.56, "1234,5": 1234.5, "1,2,3": 0.0, "(10,5)": -10.5}),
    ],
)
def test_parse_currency(spark, locale, cases):
    assert values(spark, list(cases), lambda c: T.parse_currency(c, locale)) == list(cases.values())


def test_candidates(spark):
    got = values(spark, ["12O.50", "3S0.00", "1,200.50", "", "7"], T.candidates)
    assert got[0] == ["120.50", "21O.50", "12O.05", "125.0", "12.50", "1.250"]
    assert got[1][0] == "350.00"
    assert got[2] == ["1,020.50", "1,200.05", "12005.0", "1200.50", "120.050"]
    assert got[3] == [] and got[4] == []


def test_optional_amount(spark):
    assert values(spark, ["", "0", "0.0", "0.00", "5"], T.optional_amount) == [None, None, None, 0.0, 5.0]


def test_headers(spark):
    assert values(spark, ["Transaction Date", "Withdrawals (Dr)", "Cr", "Closing Balance", "Particulars", "Payment", "", "Qty"], T.infer_field) == ["transaction_date", "debit_amount", "credit_amount", "running_balance", None, "transaction_date", None, None]
    assert values(spark, ["Particulars", "DATE ", "Withdrawals (Dr)"], T.alias_field) == ["description", "transaction_date", None]
    pairs = spark.createDataFrame([("Bal", "Balance"), ("Doc No", "Document Number"), ("Date", "Memo")], "a string, b string")
    assert [r[0] for r in pairs.select(T.headers_match_fuzzily(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_merge_headers(spark):
    df = spark.createDataFrame([(["Transaction", "Description", "Withdrawals", "Amount"], ["Date", "", "(Dr)", "amount"])], "a array<string>, b array<string>")
    assert df.select(T.merge_headers(F.col("a"), F.col("b"))).first()[0] == ["Transaction Date", "Description", "Withdrawals (Dr)", "Amount"]


def test_scrub(spark):
    got = values(spark, ["a.b@c.org called", "+65 6123 4567", "Account No: 12345", "1,234.50", "Pay HSBC now", None], T.scrub)
    assert got == ["contact@mockvendor.com called", "+1-555-0199", "Account No: ACC-XXXXXX", "1,234.50", "Pay Mock-Enterprise now", ""]


def test_dates(spark):
    assert values(spark, ["05/01/2024", "2024-01-05", "5 Jan 2024", "Jan 5, 2024", "n/a", ""], T.is_anchor) == [True, True, True, True, False, False]
    got = values(spark, ["from 01.02.2024 to 2024-03-05, due 06/03/24", "only 01/01/2024"], T.date_bounds)
    assert [tuple(g) for g in got] == [("01.02.2024", "06/03/24"), ("", "")]


def test_currency(spark):
    assert values(spark, ["total S$ 5", "€ 3", "Ringgit", "pound sterling", "nothing"], T.detect_currency) == ["SGD", "EUR", "MYR", "GBP", "USD"]
