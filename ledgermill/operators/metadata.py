"""What a statement says about itself: bank, numbers, boundary balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of, currency_of, date_bounds, parse_currency, strip
from ..lineage import once


def bank_name(text: Column) -> Column:
    """The first known bank whose name occurs; 'Unknown Bank' without one."""
    return _bank_of(F.lower(text))


def _bank_of(low: Column) -> Column:
    out = F.lit("Unknown Bank")
    for bank in reversed(K.BANKS):
        out = F.when(low.contains(bank.lower()), F.lit(bank)).otherwise(out)
    return out


def squeezed_lines(text: Column) -> Column:
    """Lines without white space, in upper case: what line_value() looks at."""
    return F.upper(reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit("")), " \t\x0b\f\r", text))


def line_value(squeezed: Column, pattern: str, group: int = 1) -> Column:
    """The first match over a text's squeezed lines; null without one. No pattern matches a line feed, so the first match
    of the whole text is that of the first line that has one."""
    return F.nullif(F.regexp_extract(squeezed, pattern, group), F.lit(""))


def with_currency(docs: DataFrame, low: str | None = None) -> DataFrame:
    """docs with the currency of their texts, and the texts in lower case where a name for them is given: made once, as
    each of the many looks would make them again."""
    found = once(once(docs, lower_text=F.lower("text")), currency=currency_of(F.col("lower_text")))
    return found.withColumnRenamed("lower_text", low) if low else found.drop("lower_text")


def text_metadata(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the metadata of (doc_id, text), with further columns of docs as they are."""
    t, s, d = F.col("text"), F.col("squeezed"), F.col("dates")
    first = F.regexp_extract(t, r"(?m)^[^\S\n]*(\S[^\n]*)", 1)
    # by steps: the code of all of them in one step is too long for the JVM to compile
    named = once(with_currency(docs.select("doc_id", "text", *also), low="low"), bank_name=_bank_of(F.col("low")))
    return once(named, squeezed=squeezed_lines(t), dates=date_bounds(t)).select(
        "doc_id", *also, "bank_name", F.coalesce(line_value(s, K.ACCOUNT_NUMBER), F.lit("")).alias("account_number"), F.when(s.rlike(K.UEN_END), line_value(s, K.UEN, 0)).alias("uen"),
        *[F.when(s.contains(mark), line_value(s, p)).alias(c) for c, mark, p in (("customer_id", "CUST", K.CUSTOMER_ID), ("salesman_id", "SALESMANID", K.SALESMAN_ID), ("term_code", "TERMCOD", K.TERM_CODE))],
        d["start_date"].alias("start_date"), d["end_date"].alias("end_date"), "currency", F.nullif(strip(first), F.lit("")).alias("first_line"),
    )


def _from_grid(grid: DataFrame, locale: str) -> DataFrame:
    """doc_id, go, gc: the first non-zero amount beside an opening and a closing phrase, by page, row, phrase, column."""
    phrases = [(side, i, p) for side, ps in enumerate((K.OPENING_PHRASES, K.CLOSING_PHRASES)) for i, p in enumerate(ps)]
    known = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("ord"), F.lit(p).alias("phrase")) for s, i, p in phrases])
    every = dict.fromkeys(p for *_, p in phrases)
    least = [p for p in every if not any(o != p and o in p for o in every)]
    rows = once(grid.select("doc_id", "page", "row", "cells"), line=F.lower(F.array_join("cells", " "))).filter(any_of([F.col("line").contains(p) for p in least]))
    hits = rows.select("*", F.explode(known).alias("k")).filter(F.col("line").contains(F.col("k.phrase")))
    cells = hits.select("doc_id", "page", "row", "k.*", F.posexplode("cells").alias("col", "text"))
    cells = once(cells.filter(F.trim("text") != ""), value=parse_currency(F.col("text"), locale)).filter((F.col("value") != 0) & ~F.lower("text").contains(F.col("phrase")))
    first = lambda side: F.min_by("value", F.when(F.col("side") == side, F.struct("page", "row", "ord", "col")))
    has = lambda side: F.bool_or(F.col("side") == side)
    out = cells.groupBy("doc_id").agg(first(0).alias("go"), first(1).alias("gc"), has(0).alias("h0"), has(1).alias("h1"))
    return out.select("doc_id", F.when(F.col("h0"), F.col("go")).alias("go"), F.when(F.col("h1"), F.col("gc")).alias("gc"))


BALANCES = ("opening", "closing", "found_opening", "found_closing")


def boundary_balances(docs: DataFrame, grid: DataFrame, locale: str = "period_decimal") -> DataFrame:
    """doc_id, opening, closing, found_opening, found_closing: from the grid, else from the text, else 0.0 and not found."""
    return with_balances(docs.select("doc_id", "text"), grid, locale).select("doc_id", *BALANCES)


def with_balances(docs: DataFrame, grid: DataFrame, locale: str = "period_decimal") -> DataFrame:
    """docs with the columns of boundary_balances(); texts are searched only where the grid says nothing."""
    text = lambda g, p: F.when(F.col(g).isNull(), F.nullif(F.regexp_extract("text", p, 1), F.lit("")))
    out = once(docs.join(_from_grid(grid, locale), "doc_id", "left"), to=text("go", K.OPENING_TEXT), tc=text("gc", K.CLOSING_TEXT))
    value = lambda g, t: F.coalesce(F.col(g), F.when(F.col(t).isNotNull(), parse_currency(F.col(t), locale)), F.lit(0.0))
    return out.select(*docs.columns, value("go", "to").alias("opening"), value("gc", "tc").alias("closing"), (F.col("go").isNotNull() | F.col("to").isNotNull()).alias("found_opening"), (F.col("gc").isNotNull() | F.col("tc").isNotNull()).alias("found_closing"))


def text_layer(grid: DataFrame) -> DataFrame:
    """doc_id and text: the rows' cells joined by spaces, rows by line feeds, in order."""
    lines = F.array_sort(F.collect_list(F.struct("page", "row", F.array_join("cells", " ").alias("line"))))
    return grid.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
