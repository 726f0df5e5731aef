"""From grids to validated statements: header, body, records, metadata, vendor, validation, repair, triage, conversion.

Everything is keyed by doc_id; the whole plan runs for any number of documents at once. Tables are written on the
way (grid, texts, facts, headers, documents, records, rows, those of grouping and repair); Statements.discard() deletes them.
Rows are judged once what needs it is asked for: lines that wait for review don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import convert, fx_rate, optional_amount, to_units
from ..lineage import collecting, discard, keep, once
from ..operators import grouping, header, ledger, metadata, profile, repair, retrieval, vendor
from ..operators.scan import Scan, numbered

Registry = tuple[DataFrame, DataFrame, DataFrame]


@dataclass
class Statements:
    """The tables of processed statements."""

    unparsed: DataFrame
    headers: DataFrame
    judge: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]
    scratch: list[DataFrame] = field(default_factory=list)

    @cached_property
    def _judged(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        with collecting(self.scratch):
            return self.judge()

    @property
    def statements(self) -> DataFrame:
        return self._judged[0]

    @property
    def transactions(self) -> DataFrame:
        return self._judged[1]

    @property
    def repairs(self) -> DataFrame:
        return self._judged[2]

    def discard(self) -> None:
        """Deletes the tables in between; the results can't be read any more after that."""
        discard(*self.scratch)


def kept_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page and n_pages of the pages that are read: the relevant ones of documents long enough for retrieval,
    all of the others; text that can't be scored drops no page."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    known = pages.join(sizes, "doc_id")
    long = profile.needs_retrieval(F.col("n_pages"))
    relevant = retrieval.relevant_pages(known.filter(long).select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")))
    return known.filter(~long).select("doc_id", "page", "n_pages").unionByName(relevant.join(sizes, "doc_id").select("doc_id", "page", "n_pages"))


def _facts(text: DataFrame, grid: DataFrame, registry: Registry | None) -> DataFrame:
    """One row a document: boundary balances, currency, and the vendor that its text names; without a registry its text as
    well, which statements are described from."""
    facts = metadata.with_currency(metadata.with_balances(text, grid))
    if registry is None:
        return facts.select("doc_id", "text", *metadata.BALANCES, "currency", F.lit(None).cast("string").alias("named"))
    facts = facts.select("doc_id", *metadata.BALANCES, "currency")
    named = vendor.match_aliases(text, registry[0], registry[1]).select("doc_id", F.col("vendor_key").alias("named"))
    return facts.join(named, "doc_id", "left")


def process(
    grid: DataFrame, text: DataFrame | None = None, registry: Registry | None = None, universal: str = "USD", rate: float = 1.0, strict: bool = False,
    documents: DataFrame | None = None, pages: DataFrame | None = None,
) -> Statements:
    """All stages over a grid (doc_id, page, row, cells).

    text (doc_id, text): text layers; a document without one gets its grid's. documents (doc_id, optionally error, path,
    filename and what profile() reads): each has a statement, with or without rows. pages (doc_id, page, text): page
    texts of paged documents; of those with many pages only the relevant ones are read.
    """
    held: list[DataFrame] = []
    with collecting(held):
        return _process(grid, text, registry, universal, rate, strict, documents, pages, held)


def _process(grid: DataFrame, text: DataFrame | None, registry: Registry | None, universal: str, rate: float, strict: bool, documents: DataFrame | None, pages: DataFrame | None, held: list[DataFrame]) -> Statements:
    table = keep
    grid = grid.select("doc_id", "page", "row", "cells")
    read = None
    if pages is not None:
        read = table(kept_pages(pages), "pages")
        unread = pages.select("doc_id", "page").join(read, ["doc_id", "page"], "left_anti")
        grid = grid.join(unread, ["doc_id", "page"], "left_anti")
    grid = table(grid, "grid")
    own = metadata.text_layer(grid)
    if text is not None:
        own = own.withColumnRenamed("text", "own").join(text.select("doc_id", "text"), "doc_id", "full").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), "own", F.lit("")).alias("text"))
    if documents is not None:
        extra = ["filename"] if "filename" in documents.columns else []
        own = documents.select("doc_id", *extra).join(own, "doc_id", "left").select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("text"))
    own = own if registry is None else table(own, "texts")
    facts = table(_facts(own, grid, registry), "facts")
    texts, facts = (facts if registry is None else own).select("doc_id", "text"), facts.drop("text")

    if registry is None:
        heads = table(header.locate(grid), "headers")
    else:
        named = facts.filter("named IS NOT NULL").select("doc_id", F.col("named").alias("vendor_key"))
        heads = table(header.locate(grid, named, (registry[0], registry[2])), "headers")
    info = facts.join(heads.select("doc_id", F.col("vendor_key").alias("shown"), "mapping", "headers"), "doc_id", "left").withColumn("vendor_key", F.coalesce("named", "shown")).drop("shown")
    if registry is not None:
        known = registry[0].select("vendor_key", "official_name", F.col("currency").alias("vendor_currency"), "exchange_rate", "numeric_locale", *[c for c in ("output_columns",) if c in registry[0].columns])
        info = info.join(known, "vendor_key", "left")
    else:
        info = info.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("official_name", "string"), ("vendor_currency", "string"), ("exchange_rate", "double"), ("numeric_locale", "string"))])
    currency = F.coalesce("vendor_currency", "currency")
    # a vendor that only the header names sets no rate: rates are decided before headers are read
    vendor_rate, before = F.when(F.col("named").isNotNull(), F.col("exchange_rate")), F.when(F.col("named").isNotNull(), currency).otherwise(F.col("currency"))
    info = info.withColumn("original_currency", currency).withColumn("rate", fx_rate(before, F.lit(universal), F.lit(rate), vendor_rate))
    info = info.withColumn("numeric_locale", F.coalesce("numeric_locale", F.lit("period_decimal")))
    info = table(info.drop("named", "vendor_currency", "exchange_rate", "currency"), "documents")

    at = F.struct("page", "row")
    placed = grid.join(heads.select("doc_id", F.struct(F.col("page"), F.col("start_row").alias("row")).alias("start"), F.col("page").alias("head_page"), "mapping"), "doc_id", "left")
    body = grouping.without_footers(placed.filter(at >= F.col("start"))).select("doc_id", "page", "row", "cells")
    records = grouping.group_wrapped(body, heads.select("doc_id", "mapping"))
    rows, undated = grouping.project(table(records, "records"), heads.select("doc_id", "mapping"))
    rows = table(rows, "rows")

    line = grouping.body_text(F.col("cells"))
    before = placed.filter(F.col("start").isNull() | (F.col("page") < F.col("head_page"))).filter(line != "")
    has_rows = rows.select("doc_id").distinct().join(info.select("doc_id"), "doc_id", "left_semi").withColumn("any_rows", F.lit(True))
    headless = before.join(has_rows, "doc_id", "left").select("doc_id", "page", "row", line.alias("raw_text"), F.lit(K.NO_HEADER).alias("reason"), F.col("any_rows").isNull().alias("review_required"))
    unparsed = undated.unionByName(headless)

    def judge() -> tuple[DataFrame, DataFrame, DataFrame]:
        judged, log, units = _judged(rows, info, strict)
        return _statements(_described(info, texts), judged, unparsed, units, documents, read), _transactions(judged, info), log

    return Statements(unparsed, heads, judge, held)


def _judged(rows: DataFrame, info: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered, repaired and judged rows, the log of repairs, and the statements' bounds in units."""
    local = info.select("doc_id", "numeric_locale", to_units(F.col("opening"), repair.SCALE).alias("opening"), to_units(F.col("closing"), repair.SCALE).alias("closing"))
    # a segment is a stretch of a page
    in_order = Scan(["doc_id"], ["page", "row"], F.col("page").cast("long") * (1 << 32) + numbered(F.col("row")), position="seq")
    rows = in_order.over(rows).withColumn("seq", (F.col("seq") - 1).cast("int")).join(local.select("doc_id", "numeric_locale"), "doc_id").withColumnRenamed("doc_id", "statement_id")
    units = local.select(F.col("doc_id").alias("statement_id"), "opening", "closing")
    checked, log = repair.repaired(rows, units, F.col("numeric_locale"), strict)
    return ledger.triage(checked, log), log, units  # of written tables; the log is small


def _transactions(judged: DataFrame, info: DataFrame) -> DataFrame:
    amount = lambda c: optional_amount(F.col(f"{c}_raw"), F.col("numeric_locale"))
    balance = F.col("balance") / repair.SCALE
    tx = judged.join(info.select(F.col("doc_id").alias("statement_id"), "rate"), "statement_id").withColumn("running_balance", balance)
    tx = once(once(tx, debit_amount=amount("debit")), credit_amount=amount("credit"))
    money = lambda c: convert(F.col(c), F.col("rate"))
    return tx.select(
        "statement_id", "seq", "transaction_date", "description", "debit_amount", "credit_amount", "running_balance", F.col("triage").alias("status"), "confidence",
        "additional_fields", money("debit_amount").alias("universal_debit"), money("credit_amount").alias("universal_credit"), money("running_balance").alias("universal_balance"),
    )


def _described(info: DataFrame, texts: DataFrame) -> DataFrame:
    """What is known of documents, with what their texts say."""
    said = metadata.text_metadata(texts).drop("currency")
    known = info.join(said, "doc_id").withColumn("vendor_name", F.coalesce("official_name", "first_line")).withColumn("bank_name", F.coalesce("official_name", "bank_name"))
    told = [c for c in said.columns if c not in ("doc_id", "first_line")]
    rest = [c for c in info.columns if c not in ("doc_id", "official_name", *metadata.BALANCES)]
    return known.select("doc_id", *metadata.BALANCES, *told, *rest, "vendor_name")


def _statements(info: DataFrame, judged: DataFrame, unparsed: DataFrame, units: DataFrame, documents: DataFrame | None, read: DataFrame | None) -> DataFrame:
    """One row a document: what is known of it, confidence, flags, which pages were read and how."""
    review = unparsed.groupBy(F.col("doc_id").alias("statement_id")).agg(F.bool_or("review_required").alias("unparsed_review"))
    found = info.select(F.col("doc_id").alias("statement_id"), "found_opening", "found_closing").join(review, "statement_id", "left")
    rolled = ledger.roll_up(judged, found)
    # the closing equation follows from totals that every row of a statement carries
    totals = judged.groupBy("statement_id").agg(*[F.first(c).alias(c) for c in ("total_credit", "total_debit", "credit_sign", "debit_sign")], F.count("*").alias("n_rows"))
    closing = ledger.closing_flag(units.join(totals, "statement_id", "left").fillna(0, ["total_credit", "total_debit", "credit_sign", "debit_sign", "n_rows"]), repair.SCALE).select("statement_id", "flag")
    out = info.withColumnRenamed("doc_id", "statement_id").join(rolled, "statement_id").join(closing, "statement_id")
    problem = F.lit(None).cast("string")
    if documents is not None:
        seen = profile.profile(documents) if "path" in documents.columns else documents
        method = profile.route(F.col("text_layer_present"), F.col("table_border_type"), F.col("layout_complexity"), F.col("merged_cell_density"), F.col("language"), F.col("header_structure")) if "path" in documents.columns else F.lit(None).cast("string")
        error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
        out = out.join(seen.select(F.col("doc_id").alias("statement_id"), method.alias("extraction_method"), error.alias("error")), "statement_id", "left")
        problem = F.col("error")
    if read is not None:
        names = read.filter(profile.needs_retrieval(F.col("n_pages"))).groupBy(F.col("doc_id").alias("statement_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("source_page"))
        out = out.join(names, "statement_id", "left").withColumn("source_page", F.coalesce("source_page", F.lit("1")))
    return out.withColumn("anomaly_flags", F.concat(F.array_compact(F.array("flag", problem)), F.col("flags"))).drop("flag", "flags")


def nested(s: Statements) -> DataFrame:
    """Statements with their transactions, repairs and unparsed lines as ordered arrays."""
    from ..operators.store import with_children

    out = with_children(s.statements, s.transactions, "statement_id", ["seq"], "transactions")
    out = with_children(out, s.repairs, "statement_id", ["seq", "field"], "repair_log")
    return with_children(out, s.unparsed.withColumnRenamed("doc_id", "statement_id"), "statement_id", ["page", "row"], "unparsed_lines")
