"""What keeps the work on each row small: only rows that matter are looked at closely."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgermill import constants as K
from ledgermill.functions.text import header_like, maybe_dated, maybe_header_like
from ledgermill.lineage import collecting
from ledgermill.operators import header, layout
from ledgermill.plans import statement
from ledgermill.sources import grids


def test_lines_that_show_no_header_are_no_candidates(spark):
    rows = [["01/02/1995", "4-NOT SPECIFIED", "", "1,234.56", "7.00"], ["Currency SGD", "", "", "", ""], ["Date", "Particulars", "Dr", "Cr", "Bal"], ["x", "D-a-t 1 e"], ["b a l", ""], ["Customer#1", "No"], ["a\x01b", ""], ["posting", "date"]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>").select("i", maybe_header_like(F.col("cells")).alias("maybe"), F.exists("cells", header_like).alias("like")).orderBy("i").collect()
    assert [r["maybe"] for r in got[:3]] == [False, False, True]
    assert all(r["maybe"] for r in got if r["like"])


def test_a_line_of_words_is_one_row(spark):
    """What is kept of words is a row a line, whose cells are cut where its words are."""
    placed = [("Date", 0, 20, 10), ("Net", 100, 120, 10), ("debit", 125, 150, 10), ("Balance", 200, 240, 10), ("a", 90, 95, 30), ("b", 100, 105, 31), ("c", 118, 130, 30), ("7", 210, 230, 30), ("x", 0, None, 50), ("y", 101, 120, 50)]
    words = spark.createDataFrame([("d", 1, i, t, float(a), None if b is None else float(b), float(y)) for i, (t, a, b, y) in enumerate(placed)], "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double")
    held = []
    with collecting(held):
        got = [r["cells"] for r in layout.grid_from_words(words).orderBy("page", "row").collect()]
    assert got == [["Date", "Net debit", "Balance"], ["", "a b c", "7"], ["x y", "", ""]]
    assert [t.count() for t in held if "lines" in t.scratch_path] == [3]


def test_files_of_few_bytes_are_made_in_many_tasks(spark):
    """Small rows that are much work are not joined into one task; each document is one file, in order of its rows."""
    grid = spark.range(400).selectExpr("cast(id % 200 as string) AS doc_id", "1 AS page", "cast(1 - id div 200 AS int) AS row", "array(cast(id AS string), 'x') AS cells")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(was, ("true", "6"), strict=True):
        spark.conf.set(k, v)
    try:
        made = grids.delimited(grid).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: bytes(r["content"]) for r in made} == {str(i): f"{i + 200},x\r\n{i},x\r\n".encode() for i in range(200)}
    assert len({r["task"] for r in made}) == 6


def test_rows_are_judged_only_where_that_is_asked_for(spark):
    """Lines that wait for review need no judged rows; what is asked for later is whole, and all tables are deleted."""
    sheet = [["Kontor"], ["Account No: AC7"], ["Opening Balance", "1.00"], ["Date", "Particulars", "Debit", "Credit", "Balance"], ["01/02/2024", "a", "", "2.00", "3.00"]]
    lost = [["no header"], ["01/02/2024", "b"]]
    grid = spark.createDataFrame([(d, 1, i, c) for d, rows in (("a", sheet), ("b", lost)) for i, c in enumerate(rows)], "doc_id string, page int, row int, cells array<string>")
    s = statement.process(grid)
    assert sorted(r["raw_text"] for r in s.unparsed.collect()) == ["01/02/2024 b", "no header"]
    assert not any("parsed-" in t.scratch_path for t in s.scratch)
    assert [(r["statement_id"], r["running_balance"], r["status"]) for r in s.transactions.collect()] == [("a", 3.0, "clean")]
    assert {r["statement_id"]: (r["vendor_name"], r["account_number"]) for r in s.statements.collect()} == {"a": ("Kontor", "AC7"), "b": ("no header", "")}
    assert any("parsed-" in t.scratch_path for t in s.scratch)


def test_lines_without_a_date_are_no_candidates(spark):
    """Every header, alone or with the line below, has a word that names a date; other lines are not compared."""
    words = [*K.HEADER_TERMS["transaction_date"], *K.HEADER_ALIASES["transaction_date"]]
    rows = [(w, True) for w in words] + [("opening balance 1.00", False), ("account no: ac15", False), ("4-not specified", False), ("1,234.56 7.00", False)]
    got = spark.createDataFrame(rows, "line string, dated boolean").select("dated", maybe_dated(F.col("line")).alias("got")).collect()
    assert all(r["got"] == r["dated"] for r in got)


def test_a_header_over_two_rows_is_found_by_its_second(spark):
    """The upper row names no date; the lower one does, and both are the header."""
    grid = spark.createDataFrame([("d", 1, 0, ["Description", "", "Net"]), ("d", 1, 1, ["", "Value date", "balance"]), ("d", 1, 2, ["x", "01/02/2024", "3.00"])], "doc_id string, page int, row int, cells array<string>")
    got = header.locate(grid).collect()
    assert [(r["row"], r["start_row"], r["headers"]) for r in got] == [(0, 2, ["Description", "Value date", "Net balance"])]
    assert got[0]["mapping"] == {"description": 0, "transaction_date": 1, "running_balance": 2}


def _rows_of(words):
    """Words (page, word_idx, text, x0, x1, top) as rows of gap-split cells, one word after the other."""
    tops, lines = {}, {}
    for page, i, text, x0, x1, top in sorted(words):
        own = tops.setdefault(page, [])
        found = next((t for t in own if abs(t - top) <= layout.ROW_TOLERANCE), top)
        if found not in own:
            own.append(found)
        lines.setdefault((page, found), []).append((x0, i, text, x1))
    out = []
    for key in sorted(lines):
        cells, end = [], None
        for x0, _, text, x1 in sorted(lines[key]):
            if end is None or x0 - end <= layout.BODY_GAP and cells:
                cells = [*cells[:-1], " ".join([*cells[-1:], text])] if cells else [text]
            else:
                cells.append(text)
            end = x1 if end is None else max(end, x1)
        out.append((key[0], cells))
    return out


def test_lines_need_a_pass_in_word_order_only_where_they_may_touch(spark, monkeypatch):
    """Lines apart from each other are found without one; stacks of lines that may touch, of any height, are as in word order."""
    rng, seen = random.Random(3), []
    plain = [(1, 10 * r + c, f"p{r}{c}", c * 30.0, c * 30.0 + 20, r * 12.0 + c % 2) for r in range(8) for c in range(4)]
    stack = [(2, i, f"s{i}", float(rng.randrange(0, 400, 7)), 0.0, rng.randrange(0, 2400) / 4) for i in range(300)]
    stack = [(p, i, t, x, x + rng.randrange(5, 60), y) for p, i, t, x, _, y in stack]
    uneven = [(3, 0, "long", 0.0, 100.0, 5.0), (3, 1, "in", 10.0, 20.0, 5.0), (3, 2, "near", 105.0, 120.0, 6.0), (3, 3, "far", 140.0, 150.0, 5.0), (3, 4, "x", 0.0, 9.0, 50.0)]
    whole = layout.lines
    monkeypatch.setattr(layout, "lines", lambda words: seen.append(sorted({r["page"] for r in words.select("page").distinct().collect()})) or whole(words))
    frame = lambda words: spark.createDataFrame([("d", *w) for w in words], "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double")
    got = layout.grid_from_words(frame(plain)).orderBy("page", "row").collect()
    assert [(r["page"], r["cells"]) for r in got] == _rows_of(plain)
    assert seen == []
    got = layout.grid_from_words(frame(plain + stack + uneven)).orderBy("page", "row").collect()
    assert [(r["page"], r["cells"]) for r in got] == _rows_of(plain + stack + uneven)
    assert seen == [[2, 3]]


def test_words_without_a_place(spark):
    """Words without a top are a line of their own; a line whose word has no right end is split as before."""
    rows = [("d", 1, 0, "a", 0.0, 10.0, None), ("d", 1, 1, "b", 50.0, 60.0, float("nan")), ("d", 1, 2, "c", 0.0, None, 3.0), ("d", 1, 3, "e", 50.0, 60.0, 3.0), ("d", 1, 4, "f", 0.0, 5.0, float("inf"))]
    words = spark.createDataFrame(rows, "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double")
    assert [r["cells"] for r in layout.grid_from_words(words).orderBy("row").collect()] == [["a", "b"], ["c e"], ["f"]]
