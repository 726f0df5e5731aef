"""Masking of personal data in statement grids, optionally with new amounts whose balances still add up.

Random values come from hashes of (seed, document, row), so the same input gives the same output on any cluster.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of, parse_currency, scrub, strip, to_units
from ..lineage import once


def _names(aliases: list[str]):
    return lambda c: any_of([(c == a) | (c.rlike(rf"\b{a}\b") if len(a) <= 3 else c.contains(a)) for a in aliases])


def _column(field: str) -> Column:
    return F.get(F.map_values(F.map_filter("map", lambda k, v: k == field)), F.lit(0))


def header_columns(cells: Column) -> Column:
    """field -> column index by the scrubber's own aliases; short ones need word boundaries."""
    low = F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    entries = []
    for field, aliases in K.SCRUB_ALIASES.items():
        at = F.array_position(F.transform(low, _names(aliases)), True)
        entries.append(F.when(at > 0, F.struct(F.lit(field).alias("key"), (at - 1).cast("int").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def _maybe_header(cells: Column) -> Column:
    """False only for rows without a date or a description column: one look at the whole line."""
    line = F.lower(F.array_join(cells, "\n"))
    return line.rlike("|".join(map(re.escape, K.SCRUB_ALIASES["transaction_date"]))) & line.rlike("|".join(map(re.escape, K.SCRUB_ALIASES["description"])))


def draw(low: int, high: int, *keys: Column) -> Column:
    """A whole number from low to high (both included) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(high - low + 1)) + low


def masked_description(ordinal: Column, number: Column) -> Column:
    """The ordinal's phrase (0-based, in a cycle) and a number."""
    return F.concat(F.element_at(F.array(*map(F.lit, K.MASKED_DESCRIPTIONS)), (F.pmod(ordinal, F.lit(len(K.MASKED_DESCRIPTIONS))) + 1).cast("int")), number.cast("string"))


def _money(units: Column) -> Column:
    return F.regexp_replace(F.format_number(units / 100, 2), ",", "")


def scrub_grid(grid: DataFrame, seed: int = 0, randomize_amounts: bool = False) -> DataFrame:
    """The grid (doc_id, page, row, cells) with masked cells; the header row of each document stays.

    The header is the first row with a date and a description column; rows below it whose date cell has no letters are
    transactions. With randomize_amounts, non-zero debits and credits and the opening balance are drawn anew, balances
    are running sums from there, and cells of opening and closing lines are rewritten to match.
    """
    order = F.struct("page", "row")
    whole = Window.partitionBy("doc_id")
    w = whole.orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    g = once(grid.select("doc_id", "page", "row", "cells"), kept=F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))))
    g = once(g.select("doc_id", "page", "row", F.col("kept").alias("cells")), m=F.when(_maybe_header(F.col("cells")), header_columns(F.col("cells"))))
    heads = F.coalesce(F.map_contains_key("m", "transaction_date") & F.map_contains_key("m", "description"), F.lit(False))
    # windows over whole documents share one shuffle: neither the head nor the first balance is joined
    g = g.withColumn("h", F.min(F.when(heads, F.struct("page", "row", F.map_entries("m").alias("entries")))).over(whole)).drop("m")
    g = once(g, map=F.map_from_entries("h.entries"))
    date = F.coalesce(F.get("cells", _column("transaction_date")), F.lit(""))
    head = F.struct("h.page", "h.row")
    below = F.col("h").isNotNull() & (order > head)
    kind = F.when(F.col("h").isNotNull() & (order == head), "header").when(below & (date != "") & ~date.rlike(r"(?U)\p{L}"), "transaction").when(below, "footer").otherwise("metadata")
    g = once(g, kind=kind, columns=F.map_values("map"), **{f"at_{f}": _column(f) for f in K.FIELDS})
    at = {f: F.col(f"at_{f}") for f in K.FIELDS}
    moves = F.col("kind") == "transaction"
    key = [F.lit(seed), F.col("doc_id"), F.col("page"), F.col("row")]
    # all but a transaction's description, which says the row's number
    masked = F.transform("cells", lambda c, i: F.when((i == at["description"]) | F.array_contains("columns", i), c).otherwise(scrub(c)))
    g = once(g, out=F.when(F.col("kind") == "header", F.col("cells")).when(moves, masked).otherwise(F.transform("cells", scrub)))
    described = lambda c, i: F.when(moves & (i == at["description"]), F.col("text")).otherwise(c)
    text = masked_description(F.col("ordinal"), draw(10_000, 99_999, *key))
    ordinal = F.sum(moves.cast("int")).over(w) - 1
    if not randomize_amounts:
        g = g.withColumn("ordinal", ordinal).withColumn("text", text)
        return g.select("doc_id", "page", "row", F.transform("out", described).alias("cells"))
    some = lambda f: ~F.coalesce(F.get("cells", at[f]), F.lit("")).isin("", "0", "0.0", "0.00")
    says = lambda *p: F.exists("out", lambda c: any_of([F.lower(c).contains(x) for x in p]))
    g = once(
        g, new_debit=F.when(moves & some("debit_amount"), draw(500, 80_000, F.lit("d"), *key)), new_credit=F.when(moves & some("credit_amount"), draw(5_000, 200_000, F.lit("c"), *key)),
        opens=(F.col("kind") == "metadata") & says("opening balance", "brought forward"), ends=(F.col("kind") == "footer") & says("closing balance", "carried forward"),
    )
    opening = F.when(F.bool_or("opens").over(whole), draw(3_000, 15_000, F.lit("o"), F.lit(seed), F.col("doc_id")) * 100)
    moved = F.coalesce(F.sum(F.coalesce("new_credit", F.lit(0)) - F.coalesce("new_debit", F.lit(0))).over(w), F.lit(0))
    g = g.select("*", ordinal.alias("ordinal"), moved.alias("moved"), opening.alias("opening"), F.min(F.when(moves, F.struct("page", "row", F.get("cells", at["running_balance"]).alias("raw")))).over(whole).alias("first"))
    first = F.when(F.col("first").isNotNull(), to_units(parse_currency(F.col("first.raw"))))
    g = once(g, start=F.coalesce("opening", first, F.lit(100_000)), text=text)
    amount = lambda new: F.when(F.col(new).isNotNull(), _money(F.col(new))).otherwise(F.lit(""))
    g = once(g, running=F.col("start") + F.col("moved"), debit=amount("new_debit"), credit=amount("new_credit"))
    g = once(g, balance=_money(F.col("running")), told=_money(F.when(F.col("opens"), F.col("start")).otherwise(F.col("running"))))
    rewritten = F.transform(
        "out",
        lambda c, i: F.when(i == at["debit_amount"], F.col("debit")).when(i == at["credit_amount"], F.col("credit")).when(i == at["running_balance"], F.col("balance")).otherwise(described(c, i)),
    )
    digits = F.array_position(F.transform("out", lambda c: c.rlike(r"\d+")), True) - 1
    boundary = F.transform("out", lambda c, i: F.when(i == digits, F.regexp_replace(c, r"[\d\.,\-]+", F.col("told"))).otherwise(c))
    cells = F.when(moves, rewritten).when(F.col("opens") | F.col("ends"), boundary).otherwise(F.col("out"))
    return g.select("doc_id", "page", "row", cells.alias("cells"))
