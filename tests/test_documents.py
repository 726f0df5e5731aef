"""Files of documents: names, clashes, and tasks that fail half-way."""

import os

import pytest
from ledgermill.sources import grids
from pyspark.sql import functions as F


def written(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def contents(spark, *names):
    return spark.createDataFrame([(n, f"of {n}".encode()) for n in names], "doc_id string, content binary").repartition(3)


def test_names_below_the_root(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    grids.write_documents(contents(spark, "file:/in/a/x.csv", "file:/in/b/x.csv", "file:/in/y.csv", "file:/in/y.xlsx", "file:/in/.csv", "file:/in/z.v1.csv", "file:/in/../up.csv", "other"), folder, ".xlsx", "file:/in")
    assert written(tmp_path / "out") == {
        "a/x.xlsx": b"of file:/in/a/x.csv", "b/x.xlsx": b"of file:/in/b/x.csv", "y.csv.xlsx": b"of file:/in/y.csv", "y.xlsx.xlsx": b"of file:/in/y.xlsx", ".csv.xlsx": b"of file:/in/.csv",
        "z.v1.xlsx": b"of file:/in/z.v1.csv", "_/up.xlsx": b"of file:/in/../up.csv", "other.xlsx": b"of other",
    }
    grids.write_documents(contents(spark, "file:/in/y.csv"), folder, ".xlsx")  # again: replaced; alone, it lies in the shared folder
    assert written(tmp_path / "out")["y.xlsx"] == b"of file:/in/y.csv"
    grids.write_documents(contents(spark, "in/a/x.csv", "in/b/x.csv"), f"file://{tmp_path}/two", ".csv")
    assert sorted(written(tmp_path / "two")) == ["a/x.csv", "b/x.csv"]
    grids.write_documents(contents(spark, "q").limit(0), f"file://{tmp_path}/none", ".csv")
    assert written(tmp_path / "none") == {}


def test_a_clash_is_an_error_before_anything_is_written(spark, tmp_path):
    with pytest.raises(ValueError, match="x.csv"):
        grids.write_documents(contents(spark, "x.csv", "x.csv", "y.csv"), f"file://{tmp_path}/out", ".csv")
    assert not (tmp_path / "out").exists()


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = contents(spark, *[f"d{i}.csv" for i in range(30)])
    broken = rows.withColumn("content", F.when(F.col("doc_id") == "d7.csv", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        grids.write_documents(broken, f"file://{tmp_path}/out", ".csv")
    assert written(tmp_path / "out") == {}
    grids.write_documents(rows, f"file://{tmp_path}/out", ".csv")
    assert len(written(tmp_path / "out")) == 30
