"""Vendors by the structure of their headers, against scores of every vendor."""

import random

import pytest
from ledgermill.functions import text as T
from ledgermill.operators import vendor
from pyspark.sql import functions as F


def brute(spark, headers, vendors, columns, threshold):
    """The best vendor of each document from all pairs, by header_score()."""
    pairs = headers.filter("trim(header) <> ''").distinct().crossJoin(columns.withColumnRenamed("header", "wanted")).withColumn("s", T.header_score(F.col("header"), F.col("wanted")))
    best = {}
    for r in pairs.groupBy("doc_id", "vendor_key", "ord", "field").agg(F.max("s").alias("s")).collect():
        best.setdefault((r["doc_id"], r["vendor_key"]), []).append(r["s"])
    order = {r["vendor_key"]: r["ord"] for r in vendors.collect()}
    out = {}
    for (doc, key), s in best.items():
        fit = (round(sum(s) / len(s), 9), -order[key], key)
        if fit[0] >= threshold:
            out[doc] = max(out.get(doc, fit), fit)
    return {doc: (fit[2], fit[0]) for doc, fit in out.items()}


WORDS = ["Date", "Txn Date", "Posting", "Details", "Narration", "Description", "Debit", "Dr", "Withdrawals (Dr)", "Credit", "Cr", "Balance", "Cum Bal", "Branch", "Ref", "日付", " ", "Amount", "Value Date", "X1"]


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.9])
def test_structure_like_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    registry = {f"v{k}": rng.sample(WORDS, rng.randint(2, 7)) for k in range(40)} | {"own": ["Quite Special", "Date", "Debit"], "empty": ["日付"]}
    vendors = spark.createDataFrame([(k, i) for i, k in enumerate(registry)], "vendor_key string, ord int")
    columns = spark.createDataFrame([(k, j, f"f{j}", h) for k, hs in registry.items() for j, h in enumerate(hs)], "vendor_key string, ord int, field string, header string")
    docs = [(d, h) for d in range(120) for h in (rng.sample(WORDS, rng.randint(1, 8)) if d % 3 else rng.choice(list(registry.values())))] + [(500, "no such thing"), (501, " ")]
    headers = spark.createDataFrame(docs, "doc_id long, header string")
    found = vendor.match_structure(headers, vendors, columns, threshold)
    got = {r["doc_id"]: (r["vendor_key"], round(r["score"], 9)) for r in found.collect()}
    assert got == brute(spark, headers, vendors, columns, threshold) and len(got) > 20
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert vendor.match_structure(headers.limit(0), vendors, columns).count() == 0 and vendor.match_structure(headers, vendors, columns.limit(0)).count() == 0
