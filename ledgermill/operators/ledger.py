"""Ledger validation: sign convention, running balance, step checks, closing equation.

A ledger has statement_id, seq, debit, credit, balance in whole units (long; see functions.text.to_units), bounds have
statement_id, opening, closing. seq numbers a statement's rows; scans run over segments of it (see scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import close_to
from ..lineage import keep, once
from .scan import Scan, numbered

LOCAL_ROWS = 10


def parse_rows(rows: DataFrame, scale: int, locale: str | Column = "period_decimal") -> DataFrame:
    """Adds debit, credit and balance in units from debit_raw, credit_raw, balance_raw; missing columns count as 0."""
    from ..functions.text import parse_currency, to_units

    for c in ("debit", "credit", "balance"):
        # one after the other: the code of all three in one step is too long for the JVM to compile
        rows = once(rows.drop(c), **{c: to_units(parse_currency(F.col(f"{c}_raw"), locale), scale)}) if f"{c}_raw" in rows.columns else rows.withColumn(c, F.lit(0).cast("long"))
    return rows


def _scan() -> Scan:
    return Scan(
        ["statement_id"], ["seq"], numbered(F.col("seq")), sums={"credit_upto": F.col("credit"), "debit_upto": F.col("debit")}, previous={"prev": F.col("balance")},
        totals={"total_credit": F.col("credit"), "total_debit": F.col("debit")}, position="rn",
    )


def _segments(ledger: DataFrame, bounds: DataFrame, scale: int) -> DataFrame:
    """A row for each segment of each statement: what lies before it, totals, opening, closing, signs and score.

    A segment's summary holds its first LOCAL_ROWS rows; those of a statement's first segments decide its signs.
    """
    scan = _scan()
    rows, name = scan.local(ledger)
    first = F.collect_list(F.when(F.col("rn") <= LOCAL_ROWS, F.struct("rn", "credit", "debit", "balance", "prev"))).alias("first_rows")
    s = keep(scan.summaries(rows, name, first).join(bounds.select("statement_id", "opening", "closing"), "statement_id"), "segments")
    seen = s.filter(F.col("before_rows") < LOCAL_ROWS).select("statement_id", "opening", "before_rows", "before_prev", F.explode("first_rows").alias("r")).filter(F.col("before_rows") + F.col("r.rn") <= LOCAL_ROWS)
    before = F.coalesce(F.coalesce("r.prev", "before_prev")["value"], "opening")
    matches = [F.count_if(close_to(F.col("r.balance"), before + c * F.col("r.credit") + d * F.col("r.debit"), scale)).alias(f"m{i}") for i, (c, d) in enumerate(K.CONVENTIONS)]
    signs = seen.groupBy("statement_id").agg(*matches)
    return s.drop("first_rows").join(signs, "statement_id").select("*", *_signs(scale)).drop(*[f"m{i}" for i in range(len(K.CONVENTIONS))])


def _signs(scale: int) -> list[Column]:
    """credit_sign, debit_sign and score from matches m0, m1, ... and totals; the earlier convention wins ties."""
    scores = [F.col(f"m{i}") + F.when(close_to(F.col("opening") + c * F.col("total_credit") + d * F.col("total_debit"), F.col("closing"), scale), 100).otherwise(0) for i, (c, d) in enumerate(K.CONVENTIONS)]
    best = F.greatest(*scores)

    def pick(k: int) -> Column:
        out = F.when(scores[0] == best, K.CONVENTIONS[0][k])
        for i in range(1, len(scores) - 1):
            out = out.when(scores[i] == best, K.CONVENTIONS[i][k])
        return out.otherwise(K.CONVENTIONS[-1][k])

    return [pick(0).alias("credit_sign"), pick(1).alias("debit_sign"), best.alias("score")]


def conventions(ledger: DataFrame, bounds: DataFrame, scale: int = 100) -> DataFrame:
    """statement_id, credit_sign, debit_sign, totals and score: the convention with most matches among the first rows,
    where one that closes the statement has 100 more; the earlier convention wins ties."""
    own = ["statement_id", "total_credit", "total_debit", "credit_sign", "debit_sign", "score"]
    found = _segments(ledger, bounds, scale).groupBy("statement_id").agg(F.sum("rows").alias("n_rows"), *[F.first(c).alias(c) for c in own[1:]])
    out = bounds.select("statement_id", "opening", "closing").join(found, "statement_id", "left")
    # a statement without rows has the first convention
    closes = F.when(close_to(F.col("opening"), F.col("closing"), scale), 100).otherwise(0)
    return out.select(
        "statement_id", "opening", "closing", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_credit", "total_debit", "n_rows")],
        F.coalesce("credit_sign", F.lit(K.CONVENTIONS[0][0])).alias("credit_sign"), F.coalesce("debit_sign", F.lit(K.CONVENTIONS[0][1])).alias("debit_sign"), F.coalesce("score", closes).alias("score"),
    )


def validate(ledger: DataFrame, bounds: DataFrame, scale: int = 100) -> DataFrame:
    """Every row with expected (the cumulative balance), status, prev_balance (the row before's balance, the opening
    balance for the first row) and step_ok (against it); also its signs and its statement's bounds and totals.

    A scan over segments of statements: a statement of any length spreads over tasks. seq numbers a statement's rows.
    """
    scan = _scan()
    rows, name = scan.local(ledger.drop("opening", "closing"))
    rows = scan.joined(rows, name, _segments(ledger, bounds, scale).withColumnRenamed("segment", name).drop("score"))
    rows = rows.withColumn("prev_balance", F.coalesce("prev", "opening"))
    rows = rows.withColumn("expected", F.col("opening") + F.col("credit_sign") * F.col("credit_upto") + F.col("debit_sign") * F.col("debit_upto"))
    rows = rows.withColumn("status", F.when(close_to(F.col("balance"), F.col("expected"), scale), "clean").otherwise("flagged"))
    rows = rows.withColumn("step_ok", close_to(F.col("balance"), F.col("prev_balance") + F.col("credit_sign") * F.col("credit") + F.col("debit_sign") * F.col("debit"), scale))
    return rows.drop("prev", "rn", "credit_upto", "debit_upto")


def closing_check(ledger: DataFrame, bounds: DataFrame, scale: int = 100) -> DataFrame:
    """statement_id, last_expected, closes, flag: the closing equation of each statement (of empty ones too)."""
    return closing_flag(conventions(ledger, bounds, scale), scale)


def closing_flag(c: DataFrame, scale: int) -> DataFrame:
    """closing_check() of statements whose signs and totals are known."""
    last = F.col("opening") + F.col("credit_sign") * F.col("total_credit") + F.col("debit_sign") * F.col("total_debit")
    c = c.withColumn("last_expected", last)
    empty = F.col("n_rows") == 0
    closes = F.when(empty, close_to(F.col("opening"), F.col("closing"), scale)).otherwise(close_to(F.col("last_expected"), F.col("closing"), scale))
    text = F.when(empty, F.lit(K.EMPTY_MISMATCH)).otherwise(F.format_string(K.CLOSING_MISMATCH, F.col("last_expected") / scale, F.col("closing") / scale))
    return c.select("statement_id", "last_expected", closes.alias("closes"), F.when(~closes, text).alias("flag"))


def broken_rows(validated: DataFrame) -> DataFrame:
    """Of each statement with a flagged row, the first row whose step fails, else the first flagged one, as a whole."""
    row, seq = F.struct(*validated.columns), F.col("seq")
    first = lambda c: F.min_by(row, F.when(c, seq))
    s = validated.groupBy("statement_id").agg(first(~F.col("step_ok")).alias("step"), first(F.col("status") == "flagged").alias("flagged"))
    return s.filter("flagged IS NOT NULL").select(F.coalesce("step", "flagged").alias("row")).select("row.*")


def first_break(validated: DataFrame) -> DataFrame:
    """statement_id and seq of the rows of broken_rows()."""
    return broken_rows(validated.select("statement_id", "seq", "step_ok", "status")).select("statement_id", "seq")


def triage(validated: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Status and confidence of every row: auto_repaired (0.85) where repaired says so, clean (1.0) or escalated (0.5)."""
    rows = validated
    if repaired is not None:
        rows = rows.join(repaired.select("statement_id", "seq", F.lit(True).alias("fixed")).distinct(), ["statement_id", "seq"], "left")
    else:
        rows = rows.withColumn("fixed", F.lit(None).cast("boolean"))
    status = F.when(F.col("fixed"), "auto_repaired").when(F.col("status") == "clean", "clean").otherwise("escalated")
    rows = rows.withColumn("triage", status)
    return rows.withColumn("confidence", F.when(F.col("triage") == "auto_repaired", 0.85).when(F.col("triage") == "clean", 1.0).otherwise(0.5)).drop("fixed")


def roll_up(triaged: DataFrame, found: DataFrame) -> DataFrame:
    """Confidence of each statement (at most 0.7 where a boundary balance was not found), review_required and flags.

    found: statement_id, found_opening, found_closing, and unparsed_review where lines wait for review.
    """
    c = triaged.groupBy("statement_id").agg(F.avg("confidence").alias("mean"), F.bool_or(F.col("triage") == "escalated").alias("escalated"))
    both = F.col("found_opening") & F.col("found_closing")
    mean = F.coalesce("mean", F.lit(1.0))
    flags = F.array_compact(F.array(*[F.when(~F.col(f"found_{k.lower()}"), F.lit(K.MISSING_BOUNDARY.format(k))) for k in ("Opening", "Closing")]))
    review = F.coalesce("escalated", F.lit(False))
    if "unparsed_review" in found.columns:
        review = review | F.coalesce("unparsed_review", F.lit(False))
    return found.join(c, "statement_id", "left").select("statement_id", F.when(both, mean).otherwise(F.least(mean, F.lit(0.7))).alias("confidence"), review.alias("review_required"), flags.alias("flags"))
