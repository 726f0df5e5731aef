"""Inputs are read once, however many steps need them."""

from ledgermill.operators import header, retrieval, scrub
from ledgermill.sources import registry

GRID = "doc_id string, page int, row int, cells array<string>"


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def stored(spark, path):
    rows = [("a", 1, 0, ["Opening Balance", "10.00", ""]), ("a", 1, 1, ["Date", "Particulars", "Balance"]), ("a", 1, 2, ["01/02/2024", "x", "9.00"]), ("b", 1, 0, ["none", "", ""])]
    spark.createDataFrame(rows, GRID).write.parquet(path)
    return spark.read.parquet(path)


def test_scrubbing_reads_its_grid_once(spark, tmp_path):
    grid = stored(spark, f"{tmp_path}/grid")
    out = scrub.scrub_grid(grid, 1, randomize_amounts=True)
    assert scans(out) == 1
    got = {(r["doc_id"], r["row"]): r["cells"] for r in out.collect()}
    assert got["a", 1] == ["Date", "Particulars", "Balance"] and got["a", 0][1] == got["a", 2][2] and got["b", 0] == ["none", "", ""]


def test_registered_headers_are_looked_for_among_kept_candidates(spark, tmp_path):
    grid = stored(spark, f"{tmp_path}/grid")
    vendors, _, columns = registry.from_dict(spark, {"v": {"official_name": "v", "columns": {"transaction_date": "Date", "description": "Particulars", "running_balance": "Balance"}}})
    out = header.locate(grid, spark.createDataFrame([("a", "v")], "doc_id string, vendor_key string"), (vendors, columns))
    assert not any(f"{tmp_path}/grid" in f for f in out.inputFiles())  # before: three times
    r = out.collect()
    assert [(x["doc_id"], x["row"], x["start_row"], x["vendor_key"]) for x in r] == [("a", 1, 2, "v")]


def test_page_scores_count_words_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, "debit debit x"), ("a", 2, "y"), ("a", 3, "z")], "doc_id string, page int, text string").write.parquet(f"{tmp_path}/pages")
    out = retrieval.bm25(spark.read.parquet(f"{tmp_path}/pages"), ["debit"])
    assert sum("text#" in line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation [" in line) == 1  # that of negative idfs; before: two
    scores = {r["page"]: r["score"] for r in out.collect()}
    assert scores[1] > 0 and scores[2] == scores[3] == 0
