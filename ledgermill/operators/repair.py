"""Repair of misread amounts.

Trying a reading means: replace one cell of the first broken row and see whether the statement closes under some sign
convention. That depends on the totals alone, so candidates are judged against totals that are computed once; nothing is
validated again for each candidate. The second round looks only at statements that the first has changed: where it found
nothing, nothing new can be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import any_of, candidates, close_to, parse_currency, to_units
from ..lineage import keep
from .ledger import broken_rows, parse_rows, validate

SCALE = 1000
ROUNDS = 2
RAW = ["debit_raw", "credit_raw", "balance_raw"]
LOG = "statement_id long, seq int, field string, raw_value string, corrected_value string, reason string, confidence double"


def closes(opening: Column, closing: Column, credit: Column, debit: Column, scale: int = SCALE) -> Column:
    """Whether some sign convention satisfies the closing equation."""
    return any_of([close_to(opening + c * credit + d * debit, closing, scale) for c, d in K.CONVENTIONS])


def corrections(checked: DataFrame, number: int, locale: str | Column, strict: bool) -> DataFrame:
    """The accepted correction of each validated statement that has one: candidates of its first broken row alone."""
    target = broken_rows(checked)
    fields = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(r).alias("raw")) for i, (f, r) in enumerate(zip(K.AMOUNT_FIELDS, RAW, strict=True))])
    tried = target.withColumn("f", F.explode(fields)).filter((F.coalesce("f.raw", F.lit("")) != "") & (F.lower("f.raw") != "none") & (F.col("f.raw") != "0.0"))
    # what a reading shifts is made with the reading: a filter on it would otherwise repeat the whole parsing
    units = lambda c: to_units(parse_currency(c, locale), SCALE)
    tried = tried.withColumn("read_as", units(F.col("f.raw")))
    readings = F.transform(candidates(F.col("f.raw")), lambda r: F.struct(r.alias("reading"), (units(r) - F.col("read_as")).alias("shift")))
    tried = tried.select("*", F.posexplode(readings).alias("pos", "try")).select("*", "try.reading", "try.shift")
    moved = lambda k: F.when(F.col("f.ord") == k, F.col("try.shift")).otherwise(F.lit(0))
    ok = closes(F.col("opening"), F.col("closing"), F.col("total_credit") + moved(1), F.col("total_debit") + moved(0))
    if strict:  # the row's own step must hold as well
        step = F.col("prev_balance") + F.col("credit_sign") * (F.col("credit") + moved(1)) + F.col("debit_sign") * (F.col("debit") + moved(0))
        ok = ok & close_to(F.col("balance") + moved(2), step, SCALE)
    first = F.min(F.struct("f.ord", "pos", F.col("seq").cast("int").alias("seq"), F.col("f.field").alias("field"), F.col("f.raw").alias("raw_value"), F.col("reading").alias("corrected_value"))).alias("fix")
    found = tried.filter(ok).groupBy("statement_id").agg(first)
    reason = F.lit(K.REPAIR_REASON.format(number))
    return found.select("statement_id", "fix.seq", "fix.field", "fix.raw_value", "fix.corrected_value", reason.alias("reason"), F.lit(0.85).alias("confidence"))


def apply(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with the cells that a round's log names."""
    change = log.select("statement_id", "seq", F.col("field").alias("fix_field"), "corrected_value")
    rows = rows.join(change, ["statement_id", "seq"], "left")
    for f, r in zip(K.AMOUNT_FIELDS, RAW, strict=True):
        rows = rows.withColumn(r, F.when(F.col("fix_field") == f, F.col("corrected_value")).otherwise(F.col(r)))
    return rows.drop("fix_field", "corrected_value")


def repaired(rows: DataFrame, bounds: DataFrame, locale: str | Column = "period_decimal", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows, validated, with corrected cells, and the log of corrections; two rounds, one correction a statement in each.

    rows: statement_id, seq, debit_raw, credit_raw, balance_raw; bounds: statement_id, opening, closing in thousandths.
    Every row is parsed and validated once; only changed statements are again. The results read tables that are written
    on the way.
    """
    table = keep
    columns = [c for c in rows.columns if c not in ("opening", "closing")]
    bounds = bounds.select("statement_id", "opening", "closing")
    judge = lambda df: validate(table(parse_rows(df, SCALE, locale), "parsed"), bounds, SCALE)
    out = table(judge(rows.select(*columns)), "validated")
    log, changed = None, out
    for number in range(1, ROUNDS + 1):
        fixes = table(corrections(changed, number, locale, strict), "repairs")
        log = fixes if log is None else log.unionByName(fixes)
        if fixes.isEmpty():
            break
        names = fixes.select("statement_id")
        changed = table(judge(apply(changed.join(names, "statement_id", "left_semi").select(*columns), fixes)), "revalidated")
        out = out.join(names, "statement_id", "left_anti").unionByName(changed)
    return out, log


def repair(rows: DataFrame, bounds: DataFrame, locale: str | Column = "period_decimal", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with corrected cells, as they came, and the log of corrections."""
    out, log = repaired(rows, bounds, locale, strict)
    return out.select(*rows.columns), log


def log_path(seq: Column, field: Column) -> Column:
    """How the audit trail names a corrected cell."""
    return F.format_string("transactions[%d].%s", seq, field)
