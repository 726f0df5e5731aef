"""Tables from positioned words (doc_id, page, word_idx, text, x0, x1, top), where a page has no ruled table.

Words form rows greedily in word order. Words apart from all others of their page by more than the tolerance, and no
further than it from each other, are a row in any order; only others need a pass over their page in word order (sorted pages
stream through it). Everything else is native: cells split at gaps, the header row gives column centres, cells go to the
nearest centre. From its words on, a line is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of
from ..lineage import keep, once
from .scan import Scan, numbered

ROW_TOLERANCE, HEADER_GAP, BODY_GAP = 4.0, 15.0, 12.0
#: Height of words that are held in one row before it is known which line they are in.
BAND = 64 * ROW_TOLERANCE
WORDS = "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double, line_top double"


def reject_small_table(n_words: F.Column, n_rows: F.Column) -> F.Column:
    """Whether a page's ruled table is only a footer of a page whose real table has no rules."""
    return (n_words > 100) & (n_rows < 8)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of whole pages in word order, page after page; only a page's line tops are held."""
    page, tops = None, []
    for words in batches:
        own = []
        for doc, number, top in zip(words["doc_id"], words["page"], words["top"], strict=True):
            if (doc, number) != page:
                page, tops = (doc, number), []
            found = next((t for t in tops if abs(t - top) <= ROW_TOLERANCE), None)
            if found is None:
                tops.append(top)
                found = top
            own.append(found)
        yield words.assign(line_top=own)


def _typed(words: DataFrame) -> DataFrame:
    return words.selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in (x.split() for x in WORDS.split(", ")) if c != "line_top"])


def lines(words: DataFrame) -> DataFrame:
    """Adds line_top: the top of the first word of the row that each word belongs to."""
    w = _typed(words)
    return w.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "word_idx").mapInPandas(_lines, WORDS)


def cells(lined: DataFrame, gap: float, running: bool = True) -> DataFrame:
    """doc_id, page, line_top, cell, text, x0, x1: words of a line joined where the gap is not wider.

    running: the gap is to the right end of the cell so far; otherwise to the word before.
    """
    w = Window.partitionBy("doc_id", "page", "line_top").orderBy("x0", "word_idx")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("x1").over(w)
    marked = lined.withColumn("cell", F.sum(F.coalesce((F.col("x0") - before > gap).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if running:  # a cell's own right end: a wider cell before it does not count
        start = Window.partitionBy("doc_id", "page", "line_top", "cell").orderBy("x0", "word_idx")
        marked = marked.withColumn("x1", F.max("x1").over(start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_idx", "text"))), lambda x: x["text"]), " ")
    return marked.groupBy("doc_id", "page", "line_top", "cell").agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _cut(first: F.Column) -> F.Column:
    """A line's words (an array, in order) cut at the cells that begin at these places."""
    return F.transform(first, lambda a, k: F.slice("words", a + 1, F.coalesce(F.get(first, k + 1), F.size("words")) - a))


def _begins(gap: float) -> F.Column:
    """Where cells of a line's words begin: after gaps to the word before."""
    wide = lambda x, i: F.when(x["x0"] - F.get("words", i - 1)["x1"] > gap, i)
    return F.concat(F.array(F.lit(0)), F.filter(F.transform("words", wide), lambda i: i > 0))


def _joined(words: F.Column) -> F.Column:
    return F.array_join(F.transform(words, lambda x: x["text"]), " ")


def header_lines(laid: DataFrame) -> DataFrame:
    """doc_id, page, line_top, words of the line with most header words (three at least), the topmost on ties."""
    first = once(laid.filter("words IS NOT NULL"), first=_begins(HEADER_GAP))
    counted = first.withColumn("n", F.size(F.filter(F.transform(_cut(F.col("first")), _joined), _hit))).filter("n >= 3")
    top = counted.groupBy("doc_id", "page").agg(F.max_by(F.struct("line_top", "words"), F.struct("n", (-F.col("line_top")).alias("up"))).alias("top"))
    return top.select("doc_id", "page", "top.line_top", "top.words")


def column_centres(laid: DataFrame) -> DataFrame:
    """doc_id, page, centres of every page: those of its own header line, else of the nearest page before with one."""
    own = cells(header_lines(laid).select("doc_id", "page", "line_top", F.inline("words")), HEADER_GAP)
    own = own.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", ((F.col("x0") + F.col("x1")) / 2).alias("c")))), lambda x: x["c"]).alias("centres"))
    pages = keep(laid.select("doc_id", "page").distinct().join(own, ["doc_id", "page"], "left"), "centres")  # a scan reads it twice
    last = Scan(["doc_id"], ["page"], numbered(F.col("page")), carried={"last_centres": F.col("centres")})
    return last.over(pages).select("doc_id", "page", F.col("last_centres").alias("centres"))


def nearest(x: F.Column, centres: F.Column) -> F.Column:
    """Index of the nearest centre; the first on ties."""
    away = F.transform(centres, lambda c: F.abs(c - x))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def _hit(text: F.Column) -> F.Column:
    return any_of([F.lower(text).contains(k) for k in K.LAYOUT_KEYWORDS])


def _stacked(words: DataFrame) -> DataFrame:
    """Adds stack and band: words of a page between which no vertical gap is wider than the tolerance, in bands of bounded
    height. Words of different stacks never share a line."""
    w = Window.partitionBy("doc_id", "page").orderBy("top")
    words = words.withColumn("top", F.nanvl("top", F.lit(None)))
    over = F.col("top") - F.lag("top").over(w) > ROW_TOLERANCE
    parted = words.withColumn("parts", F.coalesce(over & (F.col("top") != F.lag("top").over(w)), F.col("top").isNotNull()))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col("parts"), F.col("top")), ignorenulls=True).over(upto)
    return parted.select("*", F.count_if("parts").over(upto).alias("stack"), F.coalesce(F.floor((F.col("top") - begin) / BAND), F.lit(0)).alias("band")).drop("parts")


def _with_cells(rows: DataFrame, first: F.Column) -> DataFrame:
    """doc_id, page, line_top, open, cells (array of text, x0, x1 in order) and words of lines (words, open), whose cells
    begin at first. Both are null unless needed: cells of open rows, words that are neither open nor a header's.

    No keyword has a space, so a line with three cells that have one has three such words; words are looked at where the
    whole line has a keyword.
    """
    rows = once(rows, first=first)  # mostly a cell is one word
    header = F.concat_ws(" ", F.col("words.text")).rlike("(?i)" + "|".join(K.LAYOUT_KEYWORDS)) & (F.size(F.filter("words", lambda x: _hit(x["text"]))) >= 3)
    made = F.transform(_cut(F.col("first")), lambda ws: F.struct(_joined(ws).alias("text"), F.array_min(F.transform(ws, lambda x: x["x0"])).alias("x0"), F.array_max(F.transform(ws, lambda x: x["x1"])).alias("x1")))
    alone = F.transform("words", lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), x["x0"].alias("x0"), x["x1"].alias("x1")))
    cells_ = F.when(F.col("open"), F.lit(None)).when(F.size("first") == F.size("words"), alone).otherwise(made)
    return rows.select("doc_id", "page", "line_top", "open", cells_.alias("cells"), F.when(F.col("open") | header, F.col("words")).alias("words"))


def _plain_lines(stacked: DataFrame) -> DataFrame:
    """A row for each band of a stack, see _with_cells(). open: it is no line yet, or its words don't end one after the
    other, so that the word before does not tell where a cell begins."""
    listed = F.sort_array(F.collect_list(F.struct("x0", "word_idx", "text", "x1", "top"))).alias("words")
    high = F.coalesce(F.max("top") - F.min("top") > ROW_TOLERANCE, F.lit(False)) | (F.col("band") > 0)
    rows = stacked.groupBy("doc_id", "page", "stack", "band").agg(F.min(F.struct("word_idx", "top"))["top"].alias("line_top"), high.alias("high"), listed)
    rows = once(rows, ends=F.transform("words", lambda x: x["x1"]))
    in_turn = F.forall("ends", lambda x: x.isNotNull()) & (F.col("ends") == F.array_sort("ends"))
    return _with_cells(rows.withColumn("open", F.col("high") | ~in_turn), _begins(BODY_GAP))


def _other_lines(lined: DataFrame) -> DataFrame:
    """A row for each line of words that know theirs, see _with_cells(): gaps are to the right end of all words before."""
    w = Window.partitionBy("doc_id", "page", "line_top").orderBy("x0", "word_idx")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = lined.withColumn("begins", F.coalesce(F.col("x0") - before > BODY_GAP, F.lit(False)))
    rows = marked.groupBy("doc_id", "page", "line_top").agg(F.sort_array(F.collect_list(F.struct("x0", "word_idx", "text", "x1", "top", "begins"))).alias("words"))
    first = F.concat(F.array(F.lit(0)), F.filter(F.transform("words", lambda x, i: F.when(x["begins"], i)), lambda i: i > 0))
    rows = _with_cells(rows.withColumn("open", F.lit(False)), first)
    return rows.withColumn("words", F.transform("words", lambda x: x.dropFields("begins")))


def _whole_lines(words: DataFrame) -> DataFrame:
    """A row for each line, see _with_cells(). Words are dealt by pages once; stacks, lines and cells are all found where a
    page's words are."""
    laid = keep(_plain_lines(_stacked(_typed(words))), "lines")  # read by headers, pages and cells
    if laid.filter("open").isEmpty():
        return laid
    lined = lines(laid.filter("open").select("doc_id", "page", F.inline("words")))
    return laid.filter("NOT open").unionByName(keep(_other_lines(lined), "stacks"))


def grid_from_words(words: DataFrame) -> DataFrame:
    """A grid (doc_id, page, row, cells): with column centres each cell goes to the nearest one; pages without any keep
    their gap-split cells."""
    laid = _whole_lines(words)
    centres = column_centres(laid)
    middle = lambda c: (c["x0"] + c["x1"]) / 2
    split = F.transform("cells", lambda c: c["text"])
    at = F.when(F.col("centres").isNotNull(), F.transform("cells", lambda c: F.coalesce(nearest(middle(c), F.col("centres")), F.lit(0))))  # a cell without a place is not lost
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_top")) - 1
    placed = once(laid.select("doc_id", "page", number.alias("row"), "cells").join(centres, ["doc_id", "page"]), split=split, at=at)
    columns = F.sequence(F.lit(0), F.size("centres") - 1)
    beside = F.transform(columns, lambda i: F.array_join(F.filter("split", lambda text, k: F.get("at", k) == i), " "))
    single = F.transform(columns, lambda i: F.coalesce(F.get("split", (F.array_position("at", i) - 1).cast("int")), F.lit("")))
    joined = F.when(F.size(F.array_distinct("at")) == F.size("at"), single).otherwise(beside)  # mostly a column has one cell
    return placed.select("doc_id", "page", "row", F.when(F.col("at").isNull(), F.col("split")).otherwise(joined).alias("cells"))
