"""Stored statements: additions, corrections and deletions by generations."""

import os

import pytest
from ledgermill.operators.corrections import Stored
from ledgermill.operators.repair import LOG
from ledgermill.sources import generations
from ledgermill.sources.generations import Conflict, Store
from pyspark.sql import functions as F


def stored(spark, names, note=None):
    """Statements of three rows each; every one has an unparsed line and no repairs."""
    ids = spark.createDataFrame([(n,) for n in names], "statement_id string")
    headers = F.array(*map(F.lit, ["Date", "Details", "Debit", "Credit", "Balance"]))
    mapping = F.create_map(*[F.lit(x) for i, f in enumerate(["transaction_date", "description", "debit_amount", "credit_amount", "running_balance"]) for x in (f, i)])
    s = ids.select("statement_id", F.lit(100.0).alias("opening"), F.lit(97.0).alias("closing"), F.lit(1.0).alias("rate"), headers.alias("headers"), mapping.alias("mapping"), F.lit(1.0).alias("confidence"), F.lit(False).alias("review_required"), F.array().cast("array<string>").alias("anomaly_flags"))
    if note:
        s = s.withColumn("note", F.lit(note))
    amount = lambda c: F.lit(c).cast("double")
    tx = ids.select("statement_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq")).select("statement_id", "seq", F.lit("01/02/2024").alias("transaction_date"), F.lit("d").alias("description"), amount(1.0).alias("debit_amount"), amount(None).alias("credit_amount"), (99.0 - F.col("seq")).alias("running_balance"), F.lit("clean").alias("status"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("9"), F.lit("x")).alias("additional_fields"), *[amount(None).alias(f"universal_{c}") for c in ("debit", "credit", "balance")])
    unparsed = ids.select("statement_id", F.lit(1).alias("page"), F.lit(0).alias("row"), F.lit("line").alias("raw_text"), F.lit("why").alias("reason"), F.lit(False).alias("review_required"))
    return Stored(s, tx, spark.createDataFrame([], LOG.replace("statement_id long", "statement_id string")), unparsed)


def content(store):
    now = store.read()
    return {t: sorted(r["statement_id"] for r in getattr(now, t).select("statement_id").collect()) for t in generations.TABLES}


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_statements_are_added_corrected_and_deleted(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", buckets=8)
    assert content(store) == {t: [] for t in generations.TABLES}
    assert store.append(stored(spark, ["a", "b", "c", "d", "e", "f"])) == 1
    assert store.append(stored(spark, ["g", "h"], note="later")) == 2
    assert Store.create(spark, f"file://{tmp_path}/s", buckets=99).manifest().buckets == 8
    assert content(store)["transactions"] == sorted("abcdefgh" * 3) and content(store)["unparsed"] == list("abcdefgh")
    assert {r["note"] for r in store.read().statements.collect()} == {None, "later"}
    before, old = files(tmp_path), store.manifest()
    fixes = spark.createDataFrame([("a", 1, "debit_amount", "50"), ("a", 2, "description", "new"), ("zz", 0, "description", "nobody")], "statement_id string, seq int, key string, value string")
    assert store.correct(fixes) == 3
    now, new = store.manifest(), set(files(tmp_path)) - set(before)
    touched = {str(r[0]) for r in store._dealt(fixes, 8).select("_bucket").distinct().collect()}
    assert all(old.folders[t].get(b) == now.folders[t].get(b) for t in generations.TABLES for b in map(str, range(8)) if b not in touched)
    assert new and all(p.split("_bucket=")[1].split("/")[0] in touched for p in new) and before.items() <= files(tmp_path).items()
    rows = {r["seq"]: r for r in store.read().transactions.filter("statement_id = 'a'").collect()}
    assert rows[1]["debit_amount"] == 50.0 and rows[2]["description"] == "new" and len(rows) == 3
    assert store.read().statements.filter("statement_id = 'a'").first()["confidence"] < 1 and content(store)["statements"] == list("abcdefgh")
    assert store.read(manifest=old).transactions.filter("description = 'new'").count() == 0  # who began before reads on
    store.delete(spark.createDataFrame([("a",), ("h",)], "statement_id string"))
    assert content(store) == {"statements": list("bcdefg"), "transactions": sorted("bcdefg" * 3), "repairs": [], "unparsed": list("bcdefg")}
    held = len(files(tmp_path))
    store.sweep()
    assert content(store)["statements"] == list("bcdefg") and len(files(tmp_path)) < held


def test_a_writer_that_dies_changes_nothing_and_the_second_of_two_fails(spark, tmp_path, monkeypatch):
    store = Store.create(spark, f"file://{tmp_path}/s", buckets=4)
    store.append(stored(spark, ["a", "b"]))
    before, since = content(store), store.manifest()
    broken = stored(spark, ["c"])
    broken.unparsed = broken.unparsed.withColumn("raw_text", F.raise_error(F.lit("lost")).cast("string"))  # after three tables
    with pytest.raises(Exception, match="lost"):
        store.append(broken)
    assert content(store) == before and store.manifest() == since
    store.append(stored(spark, ["c"]))
    monkeypatch.setattr(Store, "manifest", lambda self: since)  # a writer that began before
    with pytest.raises(Conflict):
        store.append(stored(spark, ["d"]))
    monkeypatch.undo()
    assert content(store)["statements"] == ["a", "b", "c"]


def test_buckets_of_many_folders_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "MOST_FOLDERS", 2)
    store = Store.create(spark, f"file://{tmp_path}/s", buckets=1)
    for name in "abc":
        store.append(stored(spark, [name]))
    assert [len(f) for f in store.manifest().folders["statements"].values()] == [1] and content(store)["statements"] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="another type"):
        bad = stored(spark, ["x"])
        bad.statements = bad.statements.withColumn("opening", F.lit("text"))
        store.append(bad)
