"""Registered queries see every row of their tables, long accounts included."""

import datetime
import random
from collections import defaultdict

import pytest
from ledgermill import constants as K
from ledgermill import queries
from test_repair_model import model

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def sheets_dir(spark, tmp_path_factory):
    path, sizes = str(tmp_path_factory.mktemp("sheets")), {1: 1, 2: 9, 3: 40, 21: 2, 22: 0}
    start, owners = datetime.date(2024, 1, 1), [c for c, n in sizes.items() for _ in range(n)]
    orders = [(i, c, start + datetime.timedelta(days=i), 10.5 + i, "1-URGENT") for i, c in enumerate(owners, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(c, f"Customer {c}") for c in sizes], "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")
    return path, {c: n for c, n in sizes.items() if n}


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("events"))
    sizes = {1: 3, 3: 1, 4: 30, 6: 80, 9: 25, 12: 12, 15: 60}
    users = [u for u, n in sizes.items() for _ in range(n)]
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), u, rng.choice(["purchase", "click", "error"]), rng.randint(1, 50_000) / 100) for i, u in enumerate(users)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return path, sizes


def test_repair_of_whole_accounts_like_the_sequential_model(spark, events_dir):
    path, sizes = events_dir
    rows, bounds = queries.corrupted_rows(spark, path)
    held = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["statement_id"], r["seq"])):
        held[r["statement_id"]].append(r)
    assert {k: len(v) for k, v in held.items()} == sizes
    hit = {k: [r["seq"] for r in v if not r["debit_raw"].replace(".", "").isdigit()] for k, v in held.items()}
    assert all(len(v) <= (k % 3 == 0) for k, v in hit.items()) and max(x for v in hit.values() for x in v) > 12
    expected = set()
    for b in bounds.collect():
        own = held[b["statement_id"]]
        _, log = model(b["opening"], b["closing"], [[r["debit_raw"], r["credit_raw"], r["balance_raw"]] for r in own])
        expected |= {(b["statement_id"], own[at]["seq"], K.AMOUNT_FIELDS[f], raw, new) for _, at, f, raw, new in log}
    got = queries.QUERIES["repair_log"](spark, path).collect()
    assert {(r["statement_id"], r["seq"], r["field"], r["raw_value"], r["corrected_value"]) for r in got} == expected
    assert len(got) == len(expected)


def test_repaired_rows_are_all_rows(spark, events_dir):
    path, sizes = events_dir
    got = queries.QUERIES["repair_rows"](spark, path).groupBy("statement_id").count().collect()
    assert {r["statement_id"]: r["count"] for r in got} == sizes


def test_text_layer_of_every_sheet(spark, sheets_dir):
    path, sizes = sheets_dir
    got = sorted(tuple(r) for r in queries.QUERIES["text_layer_all"](spark, path).collect())
    assert got == sorted((str(c), f"Customer {c}", "Unknown Bank", n + 7) for c, n in sizes.items())


def test_grid_from_the_words_of_every_sheet(spark, sheets_dir):
    path, sizes = sheets_dir
    got = sorted(tuple(r) for r in queries.QUERIES["grid_from_words_all"](spark, path).collect())
    assert got == sorted((str(c), n + 1, 5) for c, n in sizes.items())


def test_flat_sheets_show_movements_of_zero(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(7, start, 2, "click", 0.0), (8, start + datetime.timedelta(minutes=1), 2, "purchase", 0.0), (9, start + datetime.timedelta(minutes=2), 2, "view", 1.5)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["ord"]: r["line"] for r in queries.QUERIES["flat_sheets"](spark, str(tmp_path)).collect()}
    assert got == {0: "Doc Date|Debit / Credit|Balance", 2: "d1|0.00|1000.00", 3: "d2|0.00|1000.00", 4: "d3|1.50|998.50"}
