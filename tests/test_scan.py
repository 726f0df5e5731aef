"""Scans over segments equal windows over whole groups, and a long group spreads over tasks."""

import random

import pytest
from ledgermill.operators import grouping, ledger, scan
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scans_equal_windows(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "SEGMENT", size)
    rng = random.Random(size)
    rows = [(g, i, rng.randint(-9, 9), rng.choice([None, "a", "b"])) for g in (1, 2, 3) for i in range(rng.choice([1, 7, 40]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, x long, s string").withColumn("segment", F.lit("mine"))
    s = scan.Scan(["g"], ["i"], scan.numbered(F.col("i")), sums={"upto": F.col("x")}, previous={"before": F.col("s")}, carried={"last": F.col("s")}, totals={"total": F.col("x")}, position="n")
    w = Window.partitionBy("g").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("*", F.sum("x").over(upto).alias("upto"), F.lag("s").over(w).alias("before"), F.last("s", ignorenulls=True).over(upto).alias("last"), F.sum("x").over(Window.partitionBy("g")).alias("total"), F.row_number().over(w).alias("n"))
    order = lambda d: sorted(map(str, d.select("g", "i", "x", "s", "segment", "upto", "before", "last", "total", "n").collect()))
    assert order(s.over(df)) == order(wanted)
    assert s.over(df.limit(0)).count() == 0


def test_a_long_statement_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so small a table would be broadcast itself
    try:
        rows = spark.range(20_000).selectExpr("if(id < 10000, 0, id % 100 + 1) statement_id", "if(id < 10000, id, (id - 10000) div 100) seq", "cast(id % 7 as long) credit", "cast(id % 5 as long) debit")
        running = F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("statement_id").orderBy("seq"))
        rows = rows.withColumn("balance", running + F.when(F.col("seq") == 7_777, 50_000).otherwise(0))
        bounds = rows.groupBy("statement_id").agg(F.lit(0).cast("long").alias("opening"), F.sum(F.col("credit") - F.col("debit")).alias("closing"))
        rows.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getConf().get('spark.checkpoint.dir')}/hot")
        out = ledger.validate(spark.read.parquet(path), bounds)
        placed = out.filter("statement_id = 0").select(F.spark_partition_id().alias("p"), F.xxhash64("expected", "step_ok").alias("h")).groupBy("p").agg(F.count("*").alias("n"), F.max("h"))
        sizes = [r["n"] for r in placed.collect()]
        assert len(sizes) >= 8 and max(sizes) <= 3_000 and sum(sizes) == 10_000
        assert [(r["statement_id"], r["seq"]) for r in ledger.first_break(out).collect()] == [(0, 7_777)]
        assert out.filter("status = 'flagged'").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_across_segments(spark, monkeypatch):
    cells = lambda date, text, amount="": [date, text, amount]
    lines = [cells("", "orphan"), cells("01/02/2024", "one", "5.00")] + [cells("", f"more {i}") for i in range(9)] + [cells("", "two", "6.00"), cells("03/02/2024", "three"), cells("", "tail")]
    grid = spark.createDataFrame([("d", 1, i, c) for i, c in enumerate(lines)], "doc_id string, page int, row int, cells array<string>")
    maps = [{"transaction_date": 0, "description": 1, "debit_amount": 2}, {"description": 1, "debit_amount": 2}]
    for m in maps:
        given = spark.createDataFrame([("d", m)], "doc_id string, mapping map<string,int>")
        whole = [tuple(r) for r in grouping.group_wrapped(grid, given).orderBy("row").collect()]
        monkeypatch.setattr(scan, "SEGMENT", 2)
        assert [tuple(r) for r in grouping.group_wrapped(grid, given).orderBy("row").collect()] == whole
        monkeypatch.setattr(scan, "SEGMENT", 100_000)
    dated = grouping.group_wrapped(grid, spark.createDataFrame([("d", maps[0])], "doc_id string, mapping map<string,int>")).orderBy("row").collect()
    assert [r["cells"][0] for r in dated] == ["", "01/02/2024", "01/02/2024", "03/02/2024"] and dated[1]["cells"][1].endswith("more 8")
