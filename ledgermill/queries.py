"""The registered query of each statement operator over the driver's tables, and the same result in DuckDB SQL.

Statements are stood in for by events (an account a user) and orders (an account a customer); amounts are whole cents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as K
from .functions import text as T
from .lineage import keep, once, shared_dir
from .operators import corrections, export, grouping, header, layout, ledger, metadata, profile, repair, report, retrieval, scrub, store, vendor
from .plans import statement
from .sources import generations, grids, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---------------------------------------------------------------- ledgers from the driver's tables

OPENING = 100_000
OFFSET = 12_345


def events_ledger(spark: SparkSession, sf_dir: str, corrupted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accounts of users: purchases and signups are credits; balances are right, or off in every 97th event."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    credit = F.col("event_type").isin("purchase", "signup")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("statement_id"), "event_id", F.row_number().over(w).cast("long").alias("seq"), F.when(credit, 0).otherwise(cents).alias("debit"), F.when(credit, cents).otherwise(0).alias("credit"))
    run = F.sum(F.col("credit") - F.col("debit")).over(Window.partitionBy("statement_id").orderBy("seq"))
    rows = rows.withColumn("balance", F.lit(OPENING) + run + (F.when(F.col("event_id") % 97 == 0, OFFSET).otherwise(0) if corrupted else F.lit(0)))
    bounds = rows.groupBy("statement_id").agg(F.lit(OPENING).cast("long").alias("opening"), (F.lit(OPENING) + F.sum(F.col("credit") - F.col("debit"))).alias("closing"))
    return rows, bounds


def orders_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Accounts of customers in a debtor's layout: invoices (debit) raise the balance, every fourth order pays."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    pays = F.col("o_orderkey") % 4 == 0
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(F.col("o_custkey").alias("statement_id"), F.row_number().over(w).cast("long").alias("seq"), F.when(pays, 0).otherwise(cents).alias("debit"), F.when(pays, cents).otherwise(0).alias("credit"))
    run = F.sum(F.col("debit") - F.col("credit")).over(Window.partitionBy("statement_id").orderBy("seq"))
    rows = rows.withColumn("balance", F.lit(OPENING) + run)
    bounds = rows.groupBy("statement_id").agg(F.lit(OPENING).cast("long").alias("opening"), (F.lit(OPENING) + F.sum(F.col("debit") - F.col("credit"))).alias("closing"))
    return rows, bounds


def _ledger_sql(corrupted: bool, source: str = "events") -> str:
    if source == "events":
        base = "SELECT user_id AS statement_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(round(value * 100) AS BIGINT) AS amount, event_type IN ('purchase', 'signup') AS cr FROM events"
        move, off = "credit - debit", f"CASE WHEN event_id % 97 = 0 THEN {OFFSET} ELSE 0 END" if corrupted else "0"
    else:
        base = "SELECT o_custkey AS statement_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderkey % 4 = 0 AS cr FROM orders"
        move, off = "debit - credit", "0"
    return f"""base AS ({base}),
    moves AS (SELECT statement_id, event_id, seq, CASE WHEN cr THEN 0 ELSE amount END AS debit, CASE WHEN cr THEN amount ELSE 0 END AS credit FROM base),
    ledger AS (SELECT *, ({OPENING} + sum({move}) OVER (PARTITION BY statement_id ORDER BY seq) + {off})::BIGINT AS balance FROM moves),
    bounds AS (SELECT statement_id, {OPENING}::BIGINT AS opening, ({OPENING} + sum({move}))::BIGINT AS closing FROM moves GROUP BY statement_id)"""


def _close(a: str, b: str) -> str:
    return f"(abs(({a}) - ({b})) * 100000 <= 100000 + abs({b}))"


_SIGNS_SQL = (
    "previous AS (SELECT l.*, opening, closing, coalesce(lag(balance) OVER w, opening) AS prev_balance, row_number() OVER w AS rn FROM ledger l JOIN bounds USING (statement_id) WINDOW w AS (PARTITION BY statement_id ORDER BY seq)),\n    matches AS (SELECT statement_id, any_value(opening) AS opening, any_value(closing) AS closing, sum(credit)::BIGINT AS tc, sum(debit)::BIGINT AS td, "
    + ", ".join(f"count(*) FILTER (WHERE rn <= 10 AND {_close('balance', f'prev_balance + {c} * credit + {d} * debit')}) AS m{i}" for i, (c, d) in enumerate(K.CONVENTIONS))
    + " FROM previous GROUP BY statement_id),\n    scores AS (SELECT *, "
    + ", ".join(f"m{i} + CASE WHEN {_close(f'opening + {c} * tc + {d} * td', 'closing')} THEN 100 ELSE 0 END AS s{i}" for i, (c, d) in enumerate(K.CONVENTIONS))
    + " FROM matches),\n    signs AS (SELECT *, greatest(s0, s1, s2, s3) AS score, "
    + ", ".join("CASE " + " ".join(f"WHEN s{i} = greatest(s0, s1, s2, s3) THEN {K.CONVENTIONS[i][k]}" for i in range(4)) + f" END AS {n}" for k, n in enumerate(("credit_sign", "debit_sign")))
    + " FROM scores)"
)
_VALID_SQL = f"""moved AS (SELECT p.*, credit_sign, debit_sign, credit_sign * credit + debit_sign * debit AS move FROM previous p JOIN signs USING (statement_id)),
    cumulated AS (SELECT *, (opening + sum(move) OVER (PARTITION BY statement_id ORDER BY seq))::BIGINT AS expected FROM moved),
    valid AS (SELECT *, CASE WHEN {_close("balance", "expected")} THEN 'clean' ELSE 'flagged' END AS status, {_close("balance", "prev_balance + move")} AS step_ok FROM cumulated)"""
_SEEN = f"WITH {_ledger_sql(True)}, {_SIGNS_SQL}, {_VALID_SQL}"


@query(f"WITH {_ledger_sql(False)} SELECT statement_id, seq, balance FROM ledger")
def running_balance(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir)
    return ledger.validate(rows, bounds).select("statement_id", "seq", F.col("expected").alias("balance"))


@query(f"{_SEEN} SELECT statement_id, seq, prev_balance, step_ok FROM valid")
def prev_balance_step(spark, sf_dir):
    return ledger.validate(*events_ledger(spark, sf_dir, True)).select("statement_id", "seq", "prev_balance", "step_ok")


@query(f"{_SEEN} SELECT statement_id, seq, expected, status FROM valid")
def row_status(spark, sf_dir):
    return ledger.validate(*events_ledger(spark, sf_dir, True)).select("statement_id", "seq", "expected", "status")


@query(f"{_SEEN} SELECT statement_id, coalesce(min(seq) FILTER (WHERE NOT step_ok), min(seq) FILTER (WHERE status = 'flagged')) AS seq FROM valid GROUP BY statement_id HAVING count(*) FILTER (WHERE status = 'flagged') > 0")
def first_break(spark, sf_dir):
    return ledger.first_break(ledger.validate(*events_ledger(spark, sf_dir, True)))


@query(f"WITH {_ledger_sql(True)}, {_SIGNS_SQL} SELECT statement_id, credit_sign, debit_sign, score::BIGINT AS score FROM signs")
def sign_convention(spark, sf_dir):
    return ledger.conventions(*events_ledger(spark, sf_dir, True)).select("statement_id", "credit_sign", "debit_sign", F.col("score").cast("long").alias("score"))


@query(f"WITH {_ledger_sql(False, 'orders')}, {_SIGNS_SQL} SELECT statement_id, credit_sign, debit_sign, score::BIGINT AS score FROM signs")
def sign_convention_debtor(spark, sf_dir):
    return ledger.conventions(*orders_ledger(spark, sf_dir)).select("statement_id", "credit_sign", "debit_sign", F.col("score").cast("long").alias("score"))


@query(f"""WITH {_ledger_sql(True)}, shifted AS (SELECT statement_id, opening, closing + CASE WHEN statement_id % 5 = 0 THEN 100000 ELSE 0 END AS closing FROM bounds),
    {_SIGNS_SQL.replace("JOIN bounds", "JOIN shifted")}, last AS (SELECT statement_id, opening + credit_sign * tc + debit_sign * td AS last_expected, closing FROM signs)
    SELECT statement_id, last_expected, {_close("last_expected", "closing")} AS closes,
           CASE WHEN NOT {_close("last_expected", "closing")} THEN printf('Closing balance mismatch: expected %.2f, got %.2f', last_expected / 100, closing / 100) END AS flag FROM last""")
def closing_equation(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir, True)
    bounds = bounds.withColumn("closing", F.col("closing") + F.when(F.col("statement_id") % 5 == 0, 100_000).otherwise(0))
    return ledger.closing_check(rows, bounds)


@query("SELECT c_custkey AS statement_id, abs(100 - c_custkey % 3 * 50 - 100) * 100000 <= 100000 + abs(100 - c_custkey % 3 * 50) AS closes FROM customer")
def empty_statement(spark, sf_dir):
    bounds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("statement_id"), F.lit(100).cast("long").alias("opening"), (100 - F.col("c_custkey") % 3 * 50).alias("closing"))
    none = spark.createDataFrame([], "statement_id long, seq long, debit long, credit long, balance long")
    return ledger.closing_check(none, bounds).select("statement_id", "closes")


@query(f"{_SEEN} SELECT statement_id, seq, CASE status WHEN 'clean' THEN 'clean' ELSE 'escalated' END AS triage, CASE status WHEN 'clean' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM valid")
def triage_status(spark, sf_dir):
    return ledger.triage(ledger.validate(*events_ledger(spark, sf_dir, True))).select("statement_id", "seq", "triage", "confidence")


@query("""SELECT event_id, CASE WHEN s = 'clean' AND c >= 0.85 THEN 'tier_0_accept' WHEN s = 'clean' THEN 'tier_1_accept_flagged' WHEN s = 'auto_repaired' THEN 'tier_2_auto_repair' ELSE 'tier_3_escalate' END AS tier
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'auto_repaired' ELSE 'escalated' END AS s, event_id % 100 / 100.0 AS c FROM events)""")
def triage_tier(spark, sf_dir):
    m = F.col("event_id") % 3
    s = F.when(m == 0, "clean").when(m == 1, "auto_repaired").otherwise("escalated")
    return table(spark, sf_dir, "events").select("event_id", T.triage_tier(s, F.col("event_id") % 100 / 100.0).alias("tier"))


@query(f"""{_SEEN}, means AS (SELECT statement_id, avg(CASE status WHEN 'clean' THEN 1.0 ELSE 0.5 END) AS mean, bool_or(status <> 'clean') AS bad FROM valid GROUP BY statement_id)
    SELECT statement_id, round(CASE WHEN statement_id % 2 = 0 THEN mean ELSE least(mean, 0.7) END, 6) AS confidence, bad AS review_required,
           CASE WHEN statement_id % 2 = 0 THEN 0 ELSE 1 END AS n_flags FROM means""")
def confidence_rollup(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir, True)
    found = bounds.select("statement_id", F.lit(True).alias("found_opening"), (F.col("statement_id") % 2 == 0).alias("found_closing"))
    out = ledger.roll_up(ledger.triage(ledger.validate(rows, bounds)), found)
    return out.select("statement_id", F.round("confidence", 6).alias("confidence"), "review_required", F.size("flags").alias("n_flags"))


# ---------------------------------------------------------------- amounts

_RAW_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN '(' || f || ')' WHEN 1 THEN '$' || f WHEN 2 THEN '12/05/2024' WHEN 3 THEN '1-2-' || f WHEN 4 THEN '' WHEN 5 THEN f || ' CR' ELSE ' -' || f || ' ' END AS raw
    FROM (SELECT *, format('{:,.2f}', l_extendedprice) AS f FROM lineitem)"""


def raw_amounts(spark, sf_dir) -> DataFrame:
    f, k = F.format_number("l_extendedprice", 2), F.col("l_linenumber") % 7
    raw = F.when(k == 0, F.concat(F.lit("("), f, F.lit(")"))).when(k == 1, F.concat(F.lit("$"), f)).when(k == 2, "12/05/2024").when(k == 3, F.concat(F.lit("1-2-"), f)).when(k == 4, "").when(k == 5, F.concat(f, F.lit(" CR"))).otherwise(F.concat(F.lit(" -"), f, F.lit(" ")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))


def parse_sql(x: str, comma: bool = False) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    sign, plain = (",", "replace(replace({k}, '.', ''), ',', '.')") if comma else (".", "replace({k}, ',', '')")
    inner = f"(CASE WHEN {s} LIKE '(%)' THEN substr({s}, 2, length({s}) - 2) ELSE {s} END)"
    value = f"TRY_CAST({plain.replace('{k}', f'regexp_replace({inner}, $$[^0-9.,-]$$, $$$$, $$g$$)')} AS DOUBLE)"
    many = lambda c: f"length({s}) - length(replace({s}, '{c}', '')) > 1"
    return f"coalesce(CASE WHEN {s} LIKE '%/%' OR {many('-')} OR {many(sign)} THEN 0 WHEN {s} LIKE '(%)' THEN -abs({value}) ELSE {value} END, 0)"


@query(f"SELECT l_orderkey, l_linenumber, raw, CAST(round({parse_sql('raw')} * 100) AS BIGINT) AS cents FROM ({_RAW_SQL})")
def currency_parse_period(spark, sf_dir):
    return raw_amounts(spark, sf_dir).select("l_orderkey", "l_linenumber", "raw", T.to_units(T.parse_currency(F.col("raw"))).alias("cents"))


@query(f"SELECT l_orderkey, l_linenumber, raw, CAST(round({parse_sql('raw', True)} * 100) AS BIGINT) AS cents FROM (SELECT l_orderkey, l_linenumber, translate(raw, ',.', '.,') AS raw FROM ({_RAW_SQL}))")
def currency_parse_comma(spark, sf_dir):
    r = raw_amounts(spark, sf_dir).withColumn("raw", F.translate("raw", ",.", ".,"))
    return r.select("l_orderkey", "l_linenumber", "raw", T.to_units(T.parse_currency(F.col("raw"), "comma_decimal")).alias("cents"))


@query(f"""SELECT p_partkey, raw, CASE WHEN raw IN ('', '0', '0.0') THEN NULL ELSE CAST(round({parse_sql('raw')} * 100) AS BIGINT) END AS cents
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0.0' WHEN 3 THEN '0.00' ELSE printf('%.2f', p_retailprice) END AS raw FROM part)""")
def null_amount_rule(spark, sf_dir):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "").when(k == 1, "0").when(k == 2, "0.0").when(k == 3, "0.00").otherwise(F.format_string("%.2f", "p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", T.to_units(T.optional_amount(F.col("raw"))).alias("cents"))


_MISREAD_SQL = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(r, '0', 'O') WHEN 1 THEN replace(r, '1', 'l') ELSE r END AS raw FROM (SELECT p_partkey, printf('%.2f', p_retailprice) AS r FROM part)"


def misread(spark, sf_dir) -> DataFrame:
    r, k = F.format_string("%.2f", "p_retailprice"), F.col("p_partkey") % 3
    raw = F.when(k == 0, F.replace(r, F.lit("0"), F.lit("O"))).when(k == 1, F.replace(r, F.lit("1"), F.lit("l"))).otherwise(r)
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


_CONFUSED_SQL = f"translate(substr(raw, i, 1), '{K.CONFUSED}', '{K.DIGITS}')"


@query(f"""WITH m AS ({_MISREAD_SQL}), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM m), made AS (
        SELECT p_partkey, raw, 1 AS kind, i, substr(raw, 1, i - 1) || {_CONFUSED_SQL} || substr(raw, i + 1) AS reading FROM d, unnest(range(1, length(raw) + 1)) u(i) WHERE {_CONFUSED_SQL} <> substr(raw, i, 1)
        UNION ALL
        SELECT p_partkey, raw, 2, i, substr(raw, 1, i - 1) || substr(raw, i + 1, 1) || substr(raw, i, 1) || substr(raw, i + 2) FROM d, unnest(range(1, length(raw))) u(i)
        WHERE regexp_matches(substr(raw, i, 2), '^[0-9][0-9]$') AND substr(raw, i, 1) <> substr(raw, i + 1, 1)
        UNION ALL
        SELECT p_partkey, raw, 3, i, substr(digits, 1, length(digits) - i) || '.' || substr(digits, length(digits) - i + 1) FROM d, unnest(range(1, least(4, length(digits)))) u(i)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, reading ORDER BY kind, i) AS rn FROM made WHERE reading <> raw AND TRY_CAST(regexp_replace(reading, '[^0-9.-]', '', 'g') AS DOUBLE) IS NOT NULL)
    SELECT p_partkey, raw, (row_number() OVER (PARTITION BY p_partkey ORDER BY kind, i) - 1)::INTEGER AS pos, reading FROM firsts WHERE rn = 1""")
def amount_candidates(spark, sf_dir):
    return misread(spark, sf_dir).select("p_partkey", "raw", F.posexplode(T.candidates(F.col("raw"))).alias("pos", "reading"))


def corrupted_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The users' whole ledgers as strings; in accounts divisible by 3, one debit has letters for digits."""
    rows, bounds = events_ledger(spark, sf_dir)
    bounds = bounds.select("statement_id", (F.col("opening") * 10).alias("opening"), (F.col("closing") * 10).alias("closing"))
    show = lambda c: F.format_string("%.2f", F.col(c) / 100)
    debits = F.count_if(F.col("debit") > 0)
    upto, all_ = debits.over(Window.partitionBy("statement_id").orderBy("seq")), debits.over(Window.partitionBy("statement_id"))
    rows = rows.withColumn("nth", upto).withColumn("debits", all_)
    hit = (F.col("statement_id") % 3 == 0) & (F.col("debit") > 0) & (F.col("nth") == F.expr("try_mod(statement_id, debits)") + 1)
    debit = F.when(hit, F.translate(show("debit"), "0158", "OISB")).otherwise(show("debit"))
    return rows.select("statement_id", F.col("seq").cast("int").alias("seq"), debit.alias("debit_raw"), show("credit").alias("credit_raw"), show("balance").alias("balance_raw")), bounds


def _near(a: str, b: str) -> str:
    return f"(abs(({a}) - ({b})) * 100000 <= 1000000 + abs({b}))"


def _units_sql(x: str) -> str:
    return f"CAST(round({parse_sql(x)} * 1000) AS BIGINT)"


def _judged_sql(rows: str, n: int) -> str:
    """valid{n}: the rows with signs, totals, status and step_ok, in thousandths."""
    best = f"greatest({', '.join(f's{i}' for i in range(4))})"
    sign = lambda k: "CASE " + " ".join(f"WHEN s{i} = {best} THEN {K.CONVENTIONS[i][k]}" for i in range(4)) + " END"
    matches = ", ".join(f"count(*) FILTER (WHERE rn <= 10 AND {_near('balance', f'prev + {c} * credit + {d} * debit')}) OVER e AS m{i}" for i, (c, d) in enumerate(K.CONVENTIONS))
    scores = ", ".join(f"m{i} + CASE WHEN {_near(f'opening + {c} * tc + {d} * td', 'closing')} THEN 100 ELSE 0 END AS s{i}" for i, (c, d) in enumerate(K.CONVENTIONS))
    return f"""parsed{n} AS (SELECT r.*, opening, closing, {", ".join(f"{_units_sql(f'{c}_raw')} AS {c}" for c in ("debit", "credit", "balance"))} FROM {rows} r JOIN tops USING (statement_id)),
    before{n} AS (SELECT *, coalesce(lag(balance) OVER w, opening) AS prev, row_number() OVER w AS rn, sum(credit) OVER w AS cu, sum(debit) OVER w AS du, sum(credit) OVER e AS tc, sum(debit) OVER e AS td
        FROM parsed{n} WINDOW w AS (PARTITION BY statement_id ORDER BY seq), e AS (PARTITION BY statement_id)),
    matched{n} AS (SELECT *, {matches} FROM before{n} WINDOW e AS (PARTITION BY statement_id)), scored{n} AS (SELECT *, {scores} FROM matched{n}),
    signed{n} AS (SELECT *, {sign(0)} AS cs, {sign(1)} AS ds FROM scored{n}),
    valid{n} AS (SELECT *, {_near('balance', 'opening + cs * cu + ds * du')} AS clean, {_near('balance', 'prev + cs * credit + ds * debit')} AS step_ok FROM signed{n})"""


def _fixes_sql(n: int, strict: bool) -> str:
    """fixes{n}: the accepted reading of each statement of valid{n} that has one."""
    confused = f"translate(substr(raw, i, 1), '{K.CONFUSED}', '{K.DIGITS}')"
    ok = " OR ".join(_near(f"opening + {c} * (tc + CASE WHEN ord = 1 THEN shift ELSE 0 END) + {d} * (td + CASE WHEN ord = 0 THEN shift ELSE 0 END)", "closing") for c, d in K.CONVENTIONS)
    if strict:
        step = "prev + cs * (credit + CASE WHEN ord = 1 THEN shift ELSE 0 END) + ds * (debit + CASE WHEN ord = 0 THEN shift ELSE 0 END)"
        ok = f"({ok}) AND {_near('balance + CASE WHEN ord = 2 THEN shift ELSE 0 END', step)}"
    return f"""breaks{n} AS (SELECT statement_id, coalesce(min(seq) FILTER (WHERE NOT step_ok), min(seq) FILTER (WHERE NOT clean)) AS seq FROM valid{n} GROUP BY 1 HAVING count(*) FILTER (WHERE NOT clean) > 0),
    cells{n} AS (SELECT v.*, unnest([0, 1, 2]) AS ord, unnest([debit_raw, credit_raw, balance_raw]) AS cell FROM valid{n} v JOIN breaks{n} USING (statement_id, seq)),
    tried{n} AS (SELECT *, regexp_replace(cell, '^\\s+|\\s+$', '', 'g') AS raw, regexp_replace(cell, '[^0-9]', '', 'g') AS digits FROM cells{n} WHERE cell NOT IN ('', '0.0') AND lower(cell) <> 'none'),
    made{n} AS (SELECT *, 1 AS kind, substr(raw, 1, i - 1) || {confused} || substr(raw, i + 1) AS reading FROM tried{n}, unnest(range(1, length(raw) + 1)) u(i) WHERE {confused} <> substr(raw, i, 1)
        UNION ALL SELECT *, 2, substr(raw, 1, i - 1) || substr(raw, i + 1, 1) || substr(raw, i, 1) || substr(raw, i + 2) FROM tried{n}, unnest(range(1, length(raw))) u(i) WHERE regexp_matches(substr(raw, i, 2), '^[0-9][0-9]$') AND substr(raw, i, 1) <> substr(raw, i + 1, 1)
        UNION ALL SELECT *, 3, substr(digits, 1, length(digits) - i) || '.' || substr(digits, length(digits) - i + 1) FROM tried{n}, unnest(range(1, least(4, length(digits)))) u(i)),
    shifted{n} AS (SELECT *, {_units_sql("reading")} - {_units_sql("cell")} AS shift FROM made{n} WHERE reading <> raw AND TRY_CAST(regexp_replace(reading, '[^0-9.-]', '', 'g') AS DOUBLE) IS NOT NULL),
    fixes{n} AS (SELECT statement_id, seq, ord, cell, reading FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY ord, kind, i) AS nth FROM shifted{n} WHERE {ok}) WHERE nth = 1),
    rows{n} AS (SELECT r.statement_id, r.seq, CASE WHEN ord = 0 THEN reading ELSE debit_raw END AS debit_raw, CASE WHEN ord = 1 THEN reading ELSE credit_raw END AS credit_raw, CASE WHEN ord = 2 THEN reading ELSE balance_raw END AS balance_raw
        FROM {"misread" if n == 1 else f"rows{n - 1}"} r LEFT JOIN fixes{n} USING (statement_id, seq))"""


def _repair_sql(strict: bool) -> str:
    """Both rounds of repair over the misread accounts of corrupted_rows()."""
    show = lambda c: f"printf('%.2f', {c} / 100)"
    return f"""WITH {_ledger_sql(False)}, tops AS (SELECT statement_id, opening * 10 AS opening, closing * 10 AS closing FROM bounds),
    counted AS (SELECT *, count(*) FILTER (WHERE debit > 0) OVER (PARTITION BY statement_id ORDER BY seq) AS nth, count(*) FILTER (WHERE debit > 0) OVER (PARTITION BY statement_id) AS debits FROM ledger),
    misread AS (SELECT statement_id, seq::INTEGER AS seq, CASE WHEN statement_id % 3 = 0 AND debit > 0 AND nth = statement_id % debits + 1 THEN translate({show("debit")}, '0158', 'OISB') ELSE {show("debit")} END AS debit_raw, {show("credit")} AS credit_raw, {show("balance")} AS balance_raw FROM counted),
    {_judged_sql("misread", 1)}, {_fixes_sql(1, strict)}, {_judged_sql("rows1", 2)}, {_fixes_sql(2, strict)},
    log AS (SELECT *, 1 AS round FROM fixes1 UNION ALL SELECT *, 2 FROM fixes2)"""


@query(f"""{_repair_sql(False)} SELECT statement_id, seq, f.field, cell AS raw_value, reading AS corrected_value, replace('{K.REPAIR_REASON}', '{{}}', round::VARCHAR) AS reason, 0.85::DOUBLE AS confidence,
    'transactions[' || seq || '].' || f.field AS path FROM log JOIN (SELECT unnest([0, 1, 2]) AS ord, unnest([{quoted(K.AMOUNT_FIELDS)}]) AS field) f USING (ord)""")
def repair_log(spark, sf_dir):
    rows, bounds = corrupted_rows(spark, sf_dir)
    log = repair.repair(rows, bounds)[1]
    return log.withColumn("path", repair.log_path(F.col("seq"), F.col("field")))


@query(f"""{_repair_sql(True)}, {_judged_sql("rows2", 3)} SELECT statement_id, v.seq, debit, credit, balance, t.triage, CASE t.triage WHEN 'auto_repaired' THEN 0.85 WHEN 'clean' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
    FROM (SELECT v.*, CASE WHEN (statement_id, seq) IN (SELECT statement_id, seq FROM log) THEN 'auto_repaired' WHEN clean THEN 'clean' ELSE 'escalated' END AS triage FROM valid3 v) v, (SELECT 1) o, LATERAL (SELECT v.triage AS triage) t""")
def repair_rows(spark, sf_dir):
    rows, bounds = corrupted_rows(spark, sf_dir)
    fixed, log = repair.repaired(rows, bounds, strict=True)
    return ledger.triage(fixed, log).select("statement_id", "seq", "debit", "credit", "balance", "triage", "confidence")


@query(f"""WITH {_ledger_sql(True)}, totals AS (SELECT statement_id, opening, closing + (statement_id % 4) * 5000000 AS closing, tc, td FROM bounds JOIN (SELECT statement_id, sum(credit)::BIGINT AS tc, sum(debit)::BIGINT AS td FROM ledger GROUP BY 1) USING (statement_id))
    SELECT statement_id, {" OR ".join(_close(f"opening + {c} * tc + {d} * td", "closing") for c, d in K.CONVENTIONS)} AS closes FROM totals""")
def repair_acceptance(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir, True)
    totals = rows.groupBy("statement_id").agg(F.sum("credit").alias("tc"), F.sum("debit").alias("td"))
    return bounds.join(totals, "statement_id").select("statement_id", repair.closes(F.col("opening"), F.col("closing") + F.col("statement_id") % 4 * 5_000_000, F.col("tc"), F.col("td"), 100).alias("closes"))


_RATES = {0: ("USD", None), 1: ("EUR", 1.09), 2: ("SGD", 0.74)}


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.09 ELSE 0.74 END::DOUBLE AS rate, CAST(round(printf('%.2f', o_totalprice * (CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.09 ELSE 0.74 END::DOUBLE))::DOUBLE * 100) AS BIGINT) AS cents
    FROM (SELECT *, o_orderkey % 3 AS k FROM orders)""")
def fx_convert(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    currency = F.when(k == 0, "USD").when(k == 1, "EUR").otherwise("SGD")
    own = F.when(k == 1, 1.09).when(k == 2, 0.74)
    o = table(spark, sf_dir, "orders").withColumn("rate", T.fx_rate(currency, F.lit("USD"), F.lit(1.0), own))
    return o.select("o_orderkey", "rate", T.to_units(T.convert(F.col("o_totalprice"), F.col("rate"))).alias("cents"))


# ---------------------------------------------------------------- rows and records

_TURNS_SQL = "turns AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, role = 'user' AS begins FROM conversations)"


def turns_grid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Conversations as pages: a user's turn has a date and begins a record, other turns continue it."""
    c = table(spark, sf_dir, "conversations")
    date = F.when(F.col("role") == "user", F.concat(F.lit("01/02/20"), F.lpad((F.col("turn") % 100).cast("string"), 2, "0"))).otherwise("")
    grid = c.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").cast("int").alias("row"), F.array(date, F.col("text"), F.lit("")).alias("cells"))
    maps = grid.select("doc_id").distinct().withColumn("mapping", F.create_map(F.lit("transaction_date"), F.lit(0), F.lit("description"), F.lit(1)))
    return grid, maps


@query(f"""WITH {_TURNS_SQL}, marked AS (SELECT *, sum(begins::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM turns),
    keyed AS (SELECT *, CASE WHEN rec = 0 THEN -1 - turn ELSE rec END AS k FROM marked)
    SELECT conv_id AS doc_id, min(turn)::INTEGER AS row, CASE WHEN k < 0 THEN '' ELSE '01/02/20' || lpad((min(turn) % 100)::VARCHAR, 2, '0') END AS date,
           regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> ''), ''), '^\\s+|\\s+$', '', 'g') AS description
    FROM keyed GROUP BY conv_id, k""")
def wrapped_rows(spark, sf_dir):
    out = grouping.group_wrapped(*turns_grid(spark, sf_dir))
    return out.select("doc_id", "row", F.col("cells")[0].alias("date"), T.strip(F.col("cells")[1]).alias("description"))


@query("""WITH b AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%d/%m/%Y') ELSE '' END AS d FROM events)
    SELECT event_id, coalesce(last_value(nullif(d, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS date FROM b""")
def date_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    date = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise("")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(w).alias("row"), "event_id", F.array(date, F.col("event_id").cast("string")).alias("cells"))
    maps = rows.select("doc_id").distinct().withColumn("mapping", F.create_map(F.lit("transaction_date"), F.lit(0), F.lit("debit_amount"), F.lit(1)))
    out = grouping.group_wrapped(rows.drop("event_id"), maps)
    return out.select(F.col("cells")[1].cast("long").alias("event_id"), F.col("cells")[0].alias("date"))


_LINES_SQL = """lines AS (SELECT doc_id, i, CASE WHEN i = n THEN CASE doc_id % 4 WHEN 0 THEN line || ' Closing Balance 10' WHEN 1 THEN 'Page ' || doc_id || ' of 9' WHEN 2 THEN 'Pagewise ' || line ELSE line END ELSE line END AS line
    FROM (SELECT doc_id, list_extract(l, i) AS line, i, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) u(i)))"""
_FOOTER_SQL = " OR ".join(f"lower(line) LIKE '%{p}%'" for p in K.FOOTER_PHRASES) + r" OR regexp_matches(lower(line), '\bpage\s+\d+\b')"


@query(f"WITH {_LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_FOOTER_SQL}) AS n_footers, count(*) FILTER (WHERE NOT ({_FOOTER_SQL}) AND trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS n_kept FROM lines GROUP BY doc_id")
def footer_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n"))
    k, line, last = F.col("doc_id") % 4, F.col("line"), F.col("i") + 1 == F.col("n")
    new = F.when(last & (k == 0), F.concat(line, F.lit(" Closing Balance 10"))).when(last & (k == 1), F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of 9"))).when(last & (k == 2), F.concat(F.lit("Pagewise "), line)).otherwise(line)
    rows = d.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "line")).select("doc_id", F.lit(1).alias("page"), F.col("i").alias("row"), F.array(new).alias("cells"))
    kept = grouping.without_footers(rows).groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    every = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_footer(F.col("cells")[0])).alias("n_footers"))
    return every.join(kept, "doc_id", "left").select("doc_id", "n_lines", "n_footers", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))


@query("""SELECT p_partkey, regexp_matches(c, '^-?[0-9.,]*[0-9][0-9.,]*$') AND length(c) - length(replace(c, '.', '')) <= 1 AS amount
    FROM (SELECT p_partkey, regexp_replace(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '$' || printf('%.2f', p_retailprice) WHEN 2 THEN '1.2.3' ELSE '-' || p_size END, '[^0-9.,-]', '', 'g') AS c FROM part)""")
def row_classify(spark, sf_dir):
    k = F.col("p_partkey") % 4
    c = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice"))).when(k == 2, "1.2.3").otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", grouping.is_amount(c).alias("amount"))


@query("""SELECT o_orderkey, s, k NOT IN (3) AS anchor, CASE WHEN k IN (0, 1) THEN CASE k WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS accepted
    FROM (SELECT *, CASE k WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') || ' 10:15' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d %b %Y') ELSE o_orderpriority END AS s FROM (SELECT *, o_orderkey % 4 AS k FROM orders))""")
def date_acceptance(spark, sf_dir):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 10:15"))).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "dd MMM yyyy")).otherwise(F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return o.select("o_orderkey", "s", T.is_anchor(F.col("s")).alias("anchor"), T.accepted_date(F.array("s"), F.lit(0)).alias("accepted"))


@query("SELECT c_custkey, unnest(['1', '3']) AS key, unnest([c_name, c_mktsegment]) AS value FROM customer")
def additional_fields(spark, sf_dir):
    cells = F.array(F.lit("2024-01-05"), F.col("c_name"), F.col("c_acctbal").cast("string"), F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("row"), cells.alias("cells"))
    maps = rows.select("doc_id", F.create_map(F.lit("transaction_date"), F.lit(0), F.lit("running_balance"), F.lit(2)).alias("mapping"))
    return grouping.project(rows, maps)[0].select(F.col("doc_id").alias("c_custkey"), F.explode("additional_fields").alias("key", "value"))


# ---------------------------------------------------------------- headers

HEADERS = [*dict.fromkeys(a for v in K.HEADER_ALIASES.values() for a in v), "Txn Date", "Particulars", "Withdrawals (Dr)", "Deposits (Cr)", "Cum. Balance", "Ref No.", "Doc. No", "Amount", "Outstanding", "Address", "Due Date", "Qty", "", "Payment", "Value", "Inv #", "Closing Balance", "Desc", "Posting"]


def headers_table(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEADERS)), "id int, header string")


def part_headers(spark, sf_dir) -> DataFrame:
    """p_partkey and two header cells of every part: one of the list, every seventh with the part's brand behind it."""
    all_, k, n = F.array(*map(F.lit, HEADERS)), F.col("p_partkey"), len(HEADERS)
    shown = lambda at, tail: F.concat(F.get(all_, at.cast("int")), F.when(tail, F.concat(F.lit(" "), F.col("p_brand"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", shown(k % n, k % 7 == 0).alias("ha"), shown((k + F.floor(k / n)) % n, k % 7 == 1).alias("hb"))


_PART_HEADERS_SQL = f"""part_headers AS (SELECT p_partkey, a.header || CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_brand ELSE '' END AS ha, b.header || CASE WHEN p_partkey % 7 = 1 THEN ' ' || p_brand ELSE '' END AS hb
    FROM part JOIN headers a ON a.id = p_partkey % {len(HEADERS)} JOIN headers b ON b.id = (p_partkey + p_partkey // {len(HEADERS)}) % {len(HEADERS)})"""


_HEADERS_SQL = "headers(id, header) AS (VALUES " + ", ".join(f"({i}, {quoted([h])})" for i, h in enumerate(HEADERS)) + ")"


def infer_sql(x: str) -> str:
    n = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    cases = []
    for field, terms in K.HEADER_TERMS.items():
        single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
        cases.append(f"WHEN list_has_any(string_split({n}, ' '), [{quoted(single)}])" + "".join(f" OR {n} LIKE '%{p}%'" for p in phrases) + f" THEN '{field}'")
    return "CASE " + " ".join(cases) + " END"


def alias_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN lower(trim({x})) IN ({quoted(a)}) THEN '{f}'" for f, a in K.HEADER_ALIASES.items()) + " END"


@query(f"WITH {_HEADERS_SQL}, {_PART_HEADERS_SQL} SELECT p_partkey, trim(regexp_replace(lower(ha), '[^a-z0-9]+', ' ', 'g')) AS normal, {infer_sql('ha')} AS field FROM part_headers")
def infer_header(spark, sf_dir):
    return part_headers(spark, sf_dir).select("p_partkey", T.normalize_header(F.col("ha")).alias("normal"), T.infer_field(F.col("ha")).alias("field"))


_NEAR_SQL = "CASE " + " ".join(f"WHEN length(h) > 2 AND (" + " OR ".join(f"h LIKE '%{a}%' OR '{a}' LIKE '%' || h || '%'" for a in al if len(a) > 2) + f") THEN '{f}'" for f, al in K.HEADER_ALIASES.items()) + " END"


@query(f"""WITH {_HEADERS_SQL}, {_PART_HEADERS_SQL}, t AS (SELECT p_partkey, {alias_sql('ha')} AS exact, {infer_sql('ha')} AS inferred, {_NEAR_SQL} AS near FROM (SELECT *, lower(trim(ha)) AS h FROM part_headers))
    SELECT p_partkey, coalesce(exact, inferred, near) AS field, CASE WHEN exact IS NOT NULL THEN 1.0 WHEN coalesce(inferred, near) IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM t""")
def map_header(spark, sf_dir):
    return part_headers(spark, sf_dir).select("p_partkey", T.map_header(F.col("ha")).alias("m")).select("p_partkey", "m.field", "m.score")


_SQUEEZE = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH {_HEADERS_SQL}, {_PART_HEADERS_SQL}, p AS (SELECT p_partkey, {_SQUEEZE.format('ha')} AS x, {_SQUEEZE.format('hb')} AS y, {infer_sql('ha')} AS fa, {infer_sql('hb')} AS fb FROM part_headers)
    SELECT p_partkey, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.85 WHEN fa = fb THEN 0.6 ELSE 0 END::DOUBLE AS score FROM p""")
def header_score(spark, sf_dir):
    return part_headers(spark, sf_dir).select("p_partkey", T.header_score(F.col("ha"), F.col("hb")).alias("score"))


_COMPARABLE = "regexp_replace(regexp_replace(lower(trim({0})), '\\b(no|num)\\b', 'number', 'g'), '[^a-z0-9]', '', 'g')"
_STRICT = "(x = y OR (length(x) >= 3 AND contains(y, x)) OR (length(y) >= 3 AND contains(x, y)))"
_SHORT = " OR ".join(f"(contains(x, '{k}') AND contains(y, '{v}')) OR (contains(y, '{k}') AND contains(x, '{v}'))" for k, v in K.HEADER_ABBREVIATIONS.items())


@query(f"""WITH {_HEADERS_SQL}, {_PART_HEADERS_SQL}, p AS (SELECT p_partkey, {_COMPARABLE.format('ha')} AS x, {_COMPARABLE.format('hb')} AS y, {infer_sql('ha')} AS fa, {infer_sql('hb')} AS fb FROM part_headers)
    SELECT p_partkey, x <> '' AND y <> '' AND {_STRICT} AS strict, x <> '' AND y <> '' AND (coalesce(fa = fb, false) OR {_STRICT} OR {_SHORT}) AS fuzzy, coalesce(fa = fb, x <> '' AND y <> '' AND {_STRICT}) AS meaning FROM p""")
def fuzzy_header(spark, sf_dir):
    a, b = F.col("ha"), F.col("hb")
    return part_headers(spark, sf_dir).select("p_partkey", T.headers_match_strictly(a, b).alias("strict"), T.headers_match_fuzzily(a, b).alias("fuzzy"), T.headers_match_by_meaning(a, b).alias("meaning"))


@query(f"""WITH {_HEADERS_SQL}, cells AS (SELECT p_partkey, c, header FROM (SELECT p_partkey, c, (p_partkey * 7 + c * (1 + p_partkey % 5)) % {len(HEADERS)} AS id FROM part, unnest(range(0, 6)) u(c)) JOIN headers USING (id) WHERE trim(header) <> ''),
    scored AS (SELECT p_partkey, c, coalesce({alias_sql('header')}, {infer_sql('header')}) AS field, CASE WHEN {alias_sql('header')} IS NOT NULL THEN 1.0 ELSE 0.85 END AS score FROM cells)
    SELECT p_partkey, field, c::INTEGER AS col FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, field ORDER BY score DESC, c) AS rn FROM scored WHERE field IS NOT NULL) WHERE rn = 1""")
def map_columns(spark, sf_dir):
    all_ = F.array(*map(F.lit, HEADERS))
    cells = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.get(all_, ((F.col("p_partkey") * 7 + c * (1 + F.col("p_partkey") % 5)) % len(HEADERS)).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", cells.alias("cells"))
    return header.map_columns(rows, ["p_partkey"]).select("p_partkey", F.explode("mapping").alias("field", "col"))


@query("""SELECT n_nationkey, CASE WHEN contains(lower(n_name), lower(r_name)) THEN n_name ELSE n_name || ' ' || r_name END AS a, r_name AS b, n_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey""")
def merge_headers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = T.merge_headers(F.array("n_name", F.lit(""), "n_name"), F.array("r_name", "r_name", F.lower("n_name")))
    return n.select("n_nationkey", m.alias("m")).select("n_nationkey", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"), F.col("m")[2].alias("c"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS at FROM orders")
def traversal_deviation(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    want = F.array(F.lit("0,0"), F.lit("0,1"), F.lit("1,0"))
    got = F.when(k == 0, want).when(k == 1, F.array(F.lit("0,0"), F.lit("0,1"), F.lit("9,9"))).otherwise(F.array(F.lit("0,0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", header.deviation(want, got).alias("at"))


# ---------------------------------------------------------------- whole statements, composed from customers and their orders


def statement_grids(spark, sf_dir) -> DataFrame:
    """A sheet for each customer: five lines of metadata, a header, their orders, a closing line."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    pays = F.col("o_orderkey") % 4 == 0
    o = table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").select(
        F.col("o_custkey").alias("statement_id"), "o_orderdate", "o_orderkey", "o_orderpriority", F.when(pays, 0).otherwise(cents).alias("debit"), F.when(pays, cents).otherwise(0).alias("credit")
    )
    account = Window.partitionBy("statement_id")
    w = account.orderBy("o_orderdate", "o_orderkey")
    money = lambda c: F.when(F.col(c) == 0, "").otherwise(F.format_number(F.col(c) / 100, 2))
    moved = F.sum(F.col("debit") - F.col("credit"))
    rows = o.select("*", F.row_number().over(w).alias("seq"), (F.lit(OPENING) + moved.over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("balance"), (F.lit(OPENING) + moved.over(account)).alias("closing"))
    cells = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), "o_orderpriority", money("debit"), money("credit"), F.format_number(F.col("balance") / 100, 2))
    owners = table(spark, sf_dir, "customer").filter("c_custkey IS NOT NULL").groupBy(F.col("c_custkey").alias("statement_id")).agg(F.collect_list(F.struct("c_name")).alias("owners"))
    k, e = F.col("statement_id"), F.lit("")
    lines = lambda owner: [
        (0, F.array(owner["c_name"], e, e, e, e)), (1, F.array(F.concat(F.lit("Account No: AC"), k.cast("string")), e, e, e, e)),
        (2, F.array(F.concat(F.lit("Currency "), F.when(k % 2 == 0, "SGD").otherwise("EUR")), e, e, e, e)), (3, F.array(F.lit("Period 01/01/1995 to 31/12/1995"), e, e, e, e)),
        (4, F.array(F.lit("Opening Balance"), F.lit(f"{OPENING / 100:,.2f}"), e, e, e)), (5, F.array(*map(F.lit, ["Date", "Particulars", "Debit", "Credit", "Balance"]))),
        (1_000_000, F.array(F.lit("Closing Balance"), F.format_number(F.col("closing") / 100, 2), e, e, e)),
    ]
    line = lambda row, x: F.struct(row.cast("int").alias("row"), x.alias("cells"))
    # a sheet's other lines come with its first order, so that sheets are made whole where their orders are
    ends = F.flatten(F.transform("owners", lambda owner: F.array(*[line(F.lit(i), x) for i, x in lines(owner)])))
    own = F.array(line(F.col("seq") + 6, cells))
    made = rows.join(owners, "statement_id", "left").select("statement_id", F.inline(F.when((F.col("seq") == 1) & F.col("owners").isNotNull(), F.concat(ends, own)).otherwise(own)))
    return made.select(k.cast("string").alias("doc_id"), F.lit(1).alias("page"), "row", "cells")


_STATEMENTS = f"WITH {_ledger_sql(False, 'orders')}"


@query(f"""{_STATEMENTS} SELECT statement_id::VARCHAR AS statement_id, c_name AS vendor_name, 'AC' || statement_id AS account_number, '01/01/1995' AS start_date, '31/12/1995' AS end_date,
    CASE WHEN statement_id % 2 = 0 THEN 'SGD' ELSE 'EUR' END AS original_currency, opening, closing, true AS found_opening, true AS found_closing, 1.0::DOUBLE AS confidence, false AS review_required
    FROM bounds JOIN customer ON c_custkey = statement_id""".replace("'01/01/1995' AS start_date, '31/12/1995'", "'01/01/1995' AS start_date, e"). replace("e AS end_date", "end_date").replace("FROM bounds JOIN", "FROM bounds JOIN (SELECT o_custkey, strftime(last(o_orderdate ORDER BY o_orderdate, o_orderkey), '%d/%m/%Y') AS end_date FROM orders GROUP BY 1) ON o_custkey = statement_id JOIN"))
def process_statements(spark, sf_dir):
    s = statement.process(statement_grids(spark, sf_dir)).statements
    return s.select("statement_id", "vendor_name", "account_number", "start_date", "end_date", "original_currency", T.to_units(F.col("opening")).alias("opening"), T.to_units(F.col("closing")).alias("closing"), "found_opening", "found_closing", "confidence", "review_required")


@query(f"""{_STATEMENTS} SELECT statement_id::VARCHAR AS statement_id, (seq - 1)::INTEGER AS seq, nullif(debit, 0) AS debit, nullif(credit, 0) AS credit, balance, 'clean' AS status FROM ledger""")
def process_transactions(spark, sf_dir):
    t = statement.process(statement_grids(spark, sf_dir)).transactions
    return t.select("statement_id", "seq", T.to_units(F.col("debit_amount")).alias("debit"), T.to_units(F.col("credit_amount")).alias("credit"), T.to_units(F.col("running_balance")).alias("balance"), "status")


@query("SELECT o_custkey::VARCHAR AS doc_id, 1 AS page, 5 AS row, 6 AS start_row, 5 AS n_fields FROM orders GROUP BY o_custkey")
def header_location(spark, sf_dir):
    h = header.locate(statement_grids(spark, sf_dir))
    return h.select("doc_id", "page", "row", "start_row", F.size("mapping").alias("n_fields"))


def _sheet_money(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '' ELSE format('{{:,.2f}}', {x} / 100) END"


_SHEET_LINES = f"""{_STATEMENTS}, dated AS (SELECT o_custkey AS statement_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, strftime(o_orderdate, '%d/%m/%Y') AS date, o_orderpriority FROM orders),
    owners AS (SELECT c_custkey AS k, c_name, opening, closing FROM customer JOIN bounds ON statement_id = c_custkey),
    lines AS (SELECT statement_id AS k, seq + 6 AS row, [date, o_orderpriority, {_sheet_money('debit')}, {_sheet_money('credit')}, format('{{:,.2f}}', balance / 100)] AS cells FROM ledger JOIN dated USING (statement_id, seq)
        UNION ALL SELECT k, 0, [c_name, '', '', '', ''] FROM owners UNION ALL SELECT k, 1, ['Account No: AC' || k, '', '', '', ''] FROM owners UNION ALL SELECT k, 2, ['Currency ' || CASE WHEN k % 2 = 0 THEN 'SGD' ELSE 'EUR' END, '', '', '', ''] FROM owners
        UNION ALL SELECT k, 3, ['Period 01/01/1995 to 31/12/1995', '', '', '', ''] FROM owners UNION ALL SELECT k, 4, ['Opening Balance', format('{{:,.2f}}', opening / 100), '', '', ''] FROM owners
        UNION ALL SELECT k, 5, ['Date', 'Particulars', 'Debit', 'Credit', 'Balance'] FROM owners UNION ALL SELECT k, 1000000, ['Closing Balance', format('{{:,.2f}}', closing / 100), '', '', ''] FROM owners)"""


@query(f"{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, md5(string_agg(array_to_string(cells, ' '), chr(10) ORDER BY row)) AS h, count(*)::INTEGER AS n FROM lines GROUP BY k")
def text_layer(spark, sf_dir):
    """Every sheet's text, line for line."""
    t = metadata.text_layer(statement_grids(spark, sf_dir))
    return t.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.size(F.split("text", "\n")).alias("n"))


@query("SELECT c_custkey::VARCHAR AS doc_id, c_name AS first_line, 'Unknown Bank' AS bank_name, (n + 7)::INTEGER AS n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def text_layer_all(spark, sf_dir):
    """What every sheet's text says first."""
    lines = F.split("text", "\n")
    return metadata.text_layer(statement_grids(spark, sf_dir)).select("doc_id", F.trim(lines[0]).alias("first_line"), metadata.bank_name(F.col("text")).alias("bank_name"), F.size(lines).alias("n"))


_NOTE_SQL = """notes AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'HSBC' WHEN 1 THEN 'chase bank' WHEN 2 THEN 'Barclays' ELSE c_name END || chr(10) || 'Account Number: A-' || c_custkey || chr(10) || 'Cust ID: ' || (c_custkey + 3000000) || chr(10)
    || 'Reg 20140812' || (c_custkey % 10) || 'G ' || chr(10) || 'Salesman ID: ' || (c_custkey % 100) || ' ' || chr(10) || 'Term Code: ' || (c_custkey % 90) || chr(10) || 'From 01.02.2024 to 2024-03-' || (10 + c_custkey % 18) || chr(10)
    || CASE c_custkey % 3 WHEN 0 THEN 'Total in S$' WHEN 1 THEN 'Pounds Sterling' ELSE 'Ringgit' END || chr(10) || 'Opening Balance: ' || printf('%.2f', c_acctbal) AS text FROM customer)"""


def notes(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    first = F.when(k % 5 == 0, "HSBC").when(k % 5 == 1, "chase bank").when(k % 5 == 2, "Barclays").otherwise(F.col("c_name"))
    money = F.when(k % 3 == 0, "Total in S$").when(k % 3 == 1, "Pounds Sterling").otherwise("Ringgit")
    text = F.format_string("%s\nAccount Number: A-%d\nCust ID: %d\nReg 20140812%dG \nSalesman ID: %d \nTerm Code: %d\nFrom 01.02.2024 to 2024-03-%d\n%s\nOpening Balance: %.2f", first, k, k + 3_000_000, k % 10, k % 100, k % 90, 10 + k % 18, money, "c_acctbal")
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'HSBC' WHEN 1 THEN 'Chase' WHEN 2 THEN 'Barclays' ELSE 'Unknown Bank' END AS bank_name, 'A-' || c_custkey AS account_number, '20140812' || (c_custkey % 10) || 'G' AS uen,
    (c_custkey + 3000000)::VARCHAR AS customer_id, (c_custkey % 100)::VARCHAR AS salesman_id, (c_custkey % 90)::VARCHAR AS term_code, '01.02.2024' AS start_date, '2024-03-' || (10 + c_custkey % 18) AS end_date,
    CASE c_custkey % 3 WHEN 0 THEN 'SGD' WHEN 1 THEN 'GBP' ELSE 'MYR' END AS currency, CASE c_custkey % 5 WHEN 0 THEN 'HSBC' WHEN 1 THEN 'chase bank' WHEN 2 THEN 'Barclays' ELSE c_name END AS first_line FROM customer""")
def metadata_fields(spark, sf_dir):
    return metadata.text_metadata(notes(spark, sf_dir))


@query(f"WITH {_NOTE_SQL} SELECT c_custkey AS doc_id, CAST(round(c_acctbal * 100) AS BIGINT) AS opening, 0::BIGINT AS closing, true AS found_opening, false AS found_closing FROM customer")
def boundary_balances(spark, sf_dir):
    t = notes(spark, sf_dir)
    none = spark.createDataFrame([], "doc_id long, page int, row int, cells array<string>")
    b = metadata.boundary_balances(t, none)
    return b.select("doc_id", T.to_units(F.col("opening")).alias("opening"), T.to_units(F.col("closing")).alias("closing"), "found_opening", "found_closing")


def sheets_in_locale(spark, sf_dir) -> DataFrame:
    """The sheets with decimal commas in their rows; a vendor of that locale issues them."""
    amounts = F.transform("cells", lambda c, i: F.when(i >= 2, F.translate(c, ",.", ".,")).otherwise(c))
    return statement_grids(spark, sf_dir).withColumn("cells", F.when((F.col("row") > 5) & (F.col("row") < 1_000_000), amounts).otherwise(F.col("cells")))


LOCAL_VENDOR = {"kontor": {"official_name": "Kontor", "aliases": ["Customer#"], "columns": dict(zip(K.FIELDS, ["Date", "Particulars", "Debit", "Credit", "Balance"], strict=True)), "numeric_locale": "comma_decimal", "currency": "CHF", "exchange_rate": 1.1}}


@query(f"""{_STATEMENTS} SELECT statement_id::VARCHAR AS statement_id, (seq - 1)::INTEGER AS seq, nullif(debit, 0) AS debit, nullif(credit, 0) AS credit, balance, CAST(round(printf('%.2f', balance / 100 * 1.1::DOUBLE)::DOUBLE * 100) AS BIGINT) AS universal, 'clean' AS status FROM ledger""")
def process_local_amounts(spark, sf_dir):
    """Rows in a vendor's own locale, converted at its rate."""
    s = statement.process(sheets_in_locale(spark, sf_dir), registry=registry.from_dict(spark, LOCAL_VENDOR))
    cents = lambda c: T.to_units(F.col(c))
    return s.transactions.select("statement_id", "seq", cents("debit_amount").alias("debit"), cents("credit_amount").alias("credit"), cents("running_balance").alias("balance"), cents("universal_balance").alias("universal"), "status")


@query(f"""{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, row::INTEGER AS row, trim(array_to_string(cells, ' ')) AS raw_text, '{K.NO_HEADER}' AS reason, true AS review_required FROM lines WHERE k % 4 = 0 AND row <> 5 ORDER BY ALL""")
def unparsed_lines(spark, sf_dir):
    """Every fourth sheet has lost its header: all its lines wait for review."""
    grid = statement_grids(spark, sf_dir)
    s = statement.process(grid.filter((F.col("doc_id").cast("long") % 4 != 0) | (F.col("row") != 5)))
    return s.unparsed.select("doc_id", "row", "raw_text", "reason", "review_required")


@query("SELECT DISTINCT o_custkey::VARCHAR AS doc_id, CASE o_custkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END AS vendor_key, 5 AS row FROM orders")
def vendor_inline(spark, sf_dir):
    """Vendors that only their header row names; a header that fits none is mapped by itself."""
    k = F.col("doc_id").cast("long") % 3
    named = F.when(k == 0, F.array(*map(F.lit, STRUCTURES["north"]))).when(k == 1, F.array(*map(F.lit, STRUCTURES["south"]))).otherwise(F.array(*map(F.lit, ["Day and date", "Remarks", "Withdrawal", "Deposit", "Bal"])))
    grid = statement_grids(spark, sf_dir).withColumn("cells", F.when(F.col("row") == 5, named).otherwise(F.col("cells")))
    vendors, _, columns = registry.from_dict(spark, {v: {"official_name": v, "columns": dict(zip(K.FIELDS, h, strict=False))} for v, h in STRUCTURES.items()})
    known = spark.createDataFrame([], "doc_id string, vendor_key string")
    return header.locate(grid, known, (vendors, columns)).select("doc_id", "vendor_key", "row")


@query("SELECT c_custkey::VARCHAR || '.' || ['csv', 'xlsx', 'xlsx'][c_custkey % 3 + 1] AS doc_id, CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE 2 END AS n_rows, c_custkey % 3 = 2 AS failed FROM customer")
def read_files(spark, sf_dir):
    """Delimited files, workbooks, and files that are neither; all remain documents."""
    k = F.col("c_custkey") % 3
    name = F.concat(F.col("c_custkey").cast("string"), F.when(k == 0, ".csv").otherwise(".xlsx"))
    c = table(spark, sf_dir, "customer").select(name.alias("doc_id"), k.alias("k"), "c_name", "c_mktsegment")
    head, body = F.array(F.lit("Name"), F.lit("Segment, or none")), F.array("c_name", "c_mktsegment")
    grid = c.select("doc_id", "k", F.lit(1).alias("page"), F.posexplode(F.array(head, body)).alias("row", "cells"))
    files = grids.delimited(grid.filter("k = 0")).unionByName(grids.workbooks(grid.filter("k = 1"))).unionByName(c.filter("k = 2").select("doc_id", F.encode("c_name", "UTF-8").alias("content")))
    parsed = grids.parse_files(files.withColumnRenamed("doc_id", "path"))
    return parsed.groupBy("doc_id").agg(F.count("row").cast("int").alias("n_rows"), (F.max("error").isNotNull()).alias("failed"))


@query("SELECT c_custkey::VARCHAR AS doc_id, unnest([0, 1])::INTEGER AS row, unnest(['name|balance|note', c_name || '|' || CASE WHEN regexp_matches(printf('%.2f', c_acctbal), '0$') THEN regexp_replace(printf('%.2f', c_acctbal), '0$', '') ELSE printf('%.2f', c_acctbal) END || '|a<b&c']) AS line FROM customer")
def workbook_round_trip(spark, sf_dir):
    """Numbers are numbers in a workbook, so a last zero goes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.array(F.lit("name"), F.lit("balance"), F.lit("note")).alias("h"), F.array("c_name", F.format_string("%.2f", "c_acctbal"), F.lit("a<b&c")).alias("b"))
    files = grids.workbooks(c.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.array("h", "b")).alias("row", "cells")))
    back = grids.grid_of(grids.parse_files(files.withColumnRenamed("doc_id", "path")))
    return back.select("doc_id", "row", F.array_join("cells", "|").alias("line"))


# rows of 100 on page 1, the rest on page 2 without a header of its own
@query(f"{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, (1 + (row > 8)::INT)::INTEGER AS page, (row_number() OVER (PARTITION BY k, row > 8 ORDER BY row) - 1)::INTEGER AS row, array_to_string(cells, '|') AS line FROM lines WHERE row >= 5 AND row < 1000000")
def grid_from_later_pages(spark, sf_dir):
    """A later page without a header takes the columns of the page before."""
    g = statement_grids(spark, sf_dir).withColumn("page", F.when(F.col("row") > 8, 2).otherwise(1))
    return _laid_out(g).select("doc_id", F.col("page").cast("int").alias("page"), F.col("row").cast("int").alias("row"), F.array_join("cells", "|").alias("line"))


@query(f"{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY row) - 1)::INTEGER AS row, array_to_string(list_filter(cells, lambda x: x <> ''), '|') AS line FROM lines WHERE row > 5 AND row < 1000000")
def grid_without_header(spark, sf_dir):
    """Pages without any header keep their gap-split cells."""
    g = statement_grids(spark, sf_dir).filter(F.col("row") != 5)
    return _laid_out(g).select("doc_id", F.col("row").cast("int").alias("row"), F.array_join("cells", "|").alias("line"))


# ---------------------------------------------------------------- vendors


@query("""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM documents), a AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS a FROM benchmark)
    SELECT doc_id, min(item_id)::VARCHAR AS vendor_key FROM t JOIN a ON contains(t, a) WHERE a <> '' GROUP BY doc_id""")
def alias_match(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    vendors = b.select(F.col("item_id").cast("string").alias("vendor_key"), F.col("item_id").alias("ord"))
    aliases = b.select(F.col("item_id").cast("string").alias("vendor_key"), F.lit(0).alias("ord"), F.col("text").alias("alias"))
    return vendor.match_aliases(table(spark, sf_dir, "documents").select("doc_id", "text"), vendors, aliases)


STRUCTURES = {"north": ["Date", "Particulars", "Debit", "Credit", "Balance"], "south": ["TxnDate", "Narrative", "Dr", "Cr", "CumBal"], "west": ["Posting", "Memo", "Paid", "Received"]}
_STRUCT_SQL = "structure(vendor_key, vord, ord, header) AS (VALUES " + ", ".join(f"('{k}', {i}, {j}, '{h}')" for i, (k, v) in enumerate(STRUCTURES.items()) for j, h in enumerate(v)) + ")"


@query(f"""WITH {_HEADERS_SQL}, {_STRUCT_SQL}, cells AS (SELECT p_partkey, header FROM (SELECT p_partkey, (p_partkey * 3 + c * (1 + p_partkey % 7)) % {len(HEADERS)} AS id FROM part, unnest(range(0, 8)) u(c)) JOIN headers USING (id) WHERE trim(header) <> ''),
    p AS (SELECT p_partkey, vendor_key, vord, ord, {_SQUEEZE.format('c.header')} AS x, {_SQUEEZE.format('s.header')} AS y, {infer_sql('c.header')} AS fa, {infer_sql('s.header')} AS fb FROM cells c, structure s),
    best AS (SELECT p_partkey, vendor_key, vord, ord, max(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.85 WHEN fa = fb THEN 0.6 ELSE 0 END) AS b FROM p GROUP BY ALL),
    means AS (SELECT p_partkey, vendor_key, vord, round(avg(b)::DOUBLE, 6) AS score FROM best GROUP BY ALL)
    SELECT p_partkey AS doc_id, vendor_key, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, vord) AS rn FROM means WHERE score >= 0.6) WHERE rn = 1""")
def vendor_structure(spark, sf_dir):
    all_ = F.array(*map(F.lit, HEADERS))
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.get(all_, ((F.col("p_partkey") * 3 + c * (1 + F.col("p_partkey") % 7)) % len(HEADERS)).cast("int")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(cells).alias("header"))
    vendors = spark.createDataFrame([(k, i) for i, k in enumerate(STRUCTURES)], "vendor_key string, ord int")
    columns = spark.createDataFrame([(k, j, f"f{j}", h) for k, v in STRUCTURES.items() for j, h in enumerate(v)], "vendor_key string, ord int, field string, header string")
    return vendor.match_structure(rows, vendors, columns, 0.6).select("doc_id", "vendor_key", F.round("score", 6).alias("score"))


@query(r"SELECT s_suppkey, regexp_replace(lower(regexp_replace(regexp_replace(s_name || ' Pvt. Ltd.XLSX', '\.(xlsx|xls|pdf|csv)', '', 'gi'), '\s+', '_', 'g')), '[^a-z0-9_]', '', 'g') AS vendor_key FROM supplier")
def vendor_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", vendor.vendor_key(F.concat("s_name", F.lit(" Pvt. Ltd.XLSX"))).alias("vendor_key"))


@query("""SELECT s_suppkey AS key, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'base ' || s_name FROM supplier WHERE s_suppkey % 3 <> 0""")
def registry_overlay(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return vendor.overlay(s.withColumn("name", F.concat(F.lit("base "), "name")), s.filter("key % 3 = 0"), "key")


@query("""WITH anchors AS (SELECT label, embedding AS anchor FROM embeddings WHERE vec_id < 20),
    s AS (SELECT e.vec_id AS id, a.label, max(round(list_cosine_similarity(e.embedding::DOUBLE[], a.anchor::DOUBLE[]), 6)) AS score FROM embeddings e, anchors a GROUP BY ALL)
    SELECT id, arg_max(label, (score, -label)) AS label FROM s GROUP BY id""")
def embedding_nearest_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    anchors = e.filter("vec_id < 20").select("label", F.col("embedding").alias("anchor"))
    out = retrieval.nearest_label(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), anchors, digits=6, plain=True)
    return out.select("id", "label")


# ---------------------------------------------------------------- retrieval

_WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_HITS_SQL = " + ".join(f"(regexp_matches(text, '{p}'))::INT" for p in K.PAGE_DATE_PATTERNS)


@query(f"SELECT doc_id, len({_WORDS_SQL}) + {_HITS_SQL} AS n FROM documents".replace(" AS n", "::INTEGER AS n").replace(f"len({_WORDS_SQL}) + {_HITS_SQL}", f"(len({_WORDS_SQL}) + {_HITS_SQL})"))
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))


_QUERY = ["the", "and", "of", "de", "la"]
_BM25_SQL = f"""pages AS (SELECT source AS doc_id, doc_id AS page, {_WORDS_SQL} AS w FROM documents), sizes AS (SELECT doc_id, page, len(w) AS size FROM pages),
    per AS (SELECT doc_id, count(*) AS pages, avg(size) AS mean_size FROM sizes GROUP BY 1), tf AS (SELECT doc_id, page, t, count(*) AS tf FROM (SELECT doc_id, page, unnest(w) AS t FROM pages) GROUP BY ALL),
    df AS (SELECT doc_id, t, ln(any_value(pages) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN per USING (doc_id) GROUP BY doc_id, t), fl AS (SELECT doc_id, avg(raw) * 0.25 AS f FROM df GROUP BY 1),
    hits AS (SELECT tf.doc_id, tf.page, sum(CASE WHEN raw < 0 THEN f ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))) AS score FROM tf JOIN df USING (doc_id, t) JOIN fl USING (doc_id) JOIN sizes USING (doc_id, page) JOIN per USING (doc_id) WHERE t IN ({quoted(_QUERY)}) GROUP BY ALL),
    scored AS (SELECT doc_id, page, coalesce(score, 0) AS score FROM sizes LEFT JOIN hits USING (doc_id, page))"""


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")


@query(f"WITH {_BM25_SQL} SELECT doc_id, page, round(score, 5) AS score FROM scored".replace("AS w FROM", "|| list_resize(['date_pattern_hit', 'date_pattern_hit', 'date_pattern_hit', 'date_pattern_hit'], " + _HITS_SQL + ") AS w FROM"))
def bm25_pages(spark, sf_dir):
    return retrieval.bm25(_pages(spark, sf_dir), _QUERY).select("doc_id", "page", F.round("score", 5).alias("score"))


@query(f"WITH {_BM25_SQL}, best AS (SELECT doc_id, max(score) AS best FROM scored GROUP BY 1) SELECT doc_id, count(*) AS n FROM scored JOIN best USING (doc_id) WHERE best <= 0 OR score >= 0.4 * best GROUP BY doc_id".replace("AS w FROM", "|| list_resize(['date_pattern_hit', 'date_pattern_hit', 'date_pattern_hit', 'date_pattern_hit'], " + _HITS_SQL + ") AS w FROM"))
def retrieval_cut(spark, sf_dir):
    return retrieval.relevant_pages(_pages(spark, sf_dir), query=_QUERY).groupBy("doc_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- masking

_SCRUB_SQL = rf"""CASE WHEN TRY_CAST(replace(replace(s, ',', ''), '$', '') AS DOUBLE) IS NOT NULL THEN s ELSE
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\p{{L}}\p{{M}}\p{{N}}_.-]+@[\p{{L}}\p{{M}}\p{{N}}_.-]+\.[\p{{L}}\p{{M}}\p{{N}}_]+', '{K.MASKS["email"]}', 'g'), '\+?\d{{1,4}}[-\s]\d{{1,5}}(?:[-\s]\d{{3,9}})?', '{K.MASKS["phone"]}', 'g'),
    '(Account\s*(?:No|Number|#)?\s*[:\-]?\s*)\b[A-Za-z0-9\-]+\b', '\1{K.MASKS["account"]}', 'gi'), '\b(?:Chase|Citi|Wells Fargo|HSBC|Barclays|Apex Bank|Aragen|Sigma|Aldrich)\b', '{K.MASKS["name"]}', 'gi') END"""


@query(rf"SELECT doc_id, md5({_SCRUB_SQL}) AS h FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)")
def scrub_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.scrub(F.col("text")).cast("binary")).alias("h"))


@query(rf"""SELECT c_custkey, {_SCRUB_SQL} AS text FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Account No: ' || c_custkey || ' at Citi' WHEN 1 THEN printf('%.2f', c_acctbal) WHEN 2 THEN 'call +65 6123 4567 or a.b@c.org' ELSE c_name END AS s FROM customer)""")
def scrub_cells(spark, sf_dir):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, F.concat(F.lit("Account No: "), F.col("c_custkey").cast("string"), F.lit(" at Citi"))).when(k == 1, F.format_string("%.2f", "c_acctbal")).when(k == 2, "call +65 6123 4567 or a.b@c.org").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.scrub(s).alias("text"))


@query(f"SELECT o_orderkey, list_extract([{quoted(K.MASKED_DESCRIPTIONS)}], ((rn - 1) % 13 + 1)::INTEGER) || (10000 + o_orderkey % 90000) AS text FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)")
def mask_description(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", scrub.masked_description(rn, 10_000 + F.col("o_orderkey") % 90_000).alias("text"))


@query(f"""{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, row::INTEGER AS row, CASE WHEN row = 1 THEN 'Account No: {K.MASKS["account"]}' WHEN row > 5 THEN cells[1] || '|' || list_extract([{quoted(K.MASKED_DESCRIPTIONS)}], ((row - 7) % 13 + 1)::INTEGER) ELSE rtrim(array_to_string(cells, '|'), '|') END AS text,
    row <= 5 OR cells[3] <> '' AS debits, true AS consistent FROM lines WHERE row NOT IN (3, 4, 1000000)""")
def scrub_statements(spark, sf_dir):
    """Masked sheets with new amounts: what is masked, what stays, and that each balance follows from the one before."""
    g = scrub.scrub_grid(statement_grids(spark, sf_dir), seed=5, randomize_amounts=True)
    cents = lambda i: T.to_units(T.parse_currency(F.col(f"raw{i}")))
    moves = F.col("row") > 5
    rows = once(once(g.filter(~F.col("row").isin(3, 4, 1_000_000)).select("doc_id", "row", "cells"), **{f"raw{i}": F.get("cells", F.lit(i)) for i in (2, 3, 4)}), **{n: F.when(moves, cents(i)) for i, n in ((2, "d"), (3, "c"), (4, "b"))})
    ok = F.coalesce(F.lag("b").over(Window.partitionBy("doc_id").orderBy("row")) + F.col("c") - F.col("d") == F.col("b"), F.lit(True))
    phrase = F.concat(F.get("cells", F.lit(0)), F.lit("|"), F.regexp_replace(F.get("cells", F.lit(1)), "[0-9]{5}$", ""))
    text = F.when(moves, phrase).otherwise(F.rtrim(F.array_join("cells", "|"), F.lit("|")))
    return rows.select("doc_id", F.col("row").cast("int").alias("row"), text.alias("text"), (~moves | (F.col("d") > 0)).alias("debits"), ok.alias("consistent"))


# ---------------------------------------------------------------- reports


@query(f"""WITH {_ledger_sql(True)}, t AS (SELECT statement_id, sum(credit)::BIGINT AS total_credit, sum(debit)::BIGINT AS total_debit FROM ledger GROUP BY 1), shifted AS (SELECT statement_id, opening, closing + statement_id % 2 * 7 AS closing FROM bounds)
    SELECT statement_id, total_credit, total_debit, opening + total_credit - total_debit AS calculated_closing, opening + total_credit - total_debit - closing AS discrepancy,
           CASE WHEN abs(opening + total_credit - total_debit - closing) <= 1 THEN 'PASS' ELSE 'FAIL' END AS check_status FROM shifted JOIN t USING (statement_id)""")
def invariants(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir, True)
    return export.invariants(rows, bounds.withColumn("closing", F.col("closing") + F.col("statement_id") % 2 * 7)).select("statement_id", "total_credit", "total_debit", "calculated_closing", "discrepancy", "check_status")


@query(f"{_SEEN} SELECT statement_id, seq, CASE status WHEN 'clean' THEN 'Clean validation.' ELSE 'Escalated for manual review: balance equation mismatch.' END AS note FROM valid")
def ledger_notes(spark, sf_dir):
    return ledger.triage(ledger.validate(*events_ledger(spark, sf_dir, True))).select("statement_id", "seq", export.ledger_note(F.col("triage")).alias("note"))


@query(f"WITH {_ledger_sql(False)} SELECT statement_id, sum(debit)::BIGINT AS total_debit, sum(credit)::BIGINT AS total_credit, count(*) AS n_rows FROM ledger GROUP BY ROLLUP (statement_id)")
def ledger_total(spark, sf_dir):
    return export.ledger_totals(events_ledger(spark, sf_dir)[0])


@query(f"WITH {_ledger_sql(False)} SELECT 'e' || event_id AS \"Particulars\", debit AS \"Withdrawal\", credit AS \"Cr\", CASE WHEN debit > 0 THEN debit ELSE credit END AS \"Dr/Cr\", balance AS \"Cum Balance\", 'x' || event_id AS \"Branch\" FROM ledger")
def flat_ledger(spark, sf_dir):
    rows, _ = events_ledger(spark, sf_dir)
    tx = rows.select("seq", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("description"), F.col("debit").alias("d"), F.col("debit").alias("debit_amount"), F.col("credit").alias("credit_amount"), F.col("balance").alias("running_balance"), F.create_map(F.lit("5"), F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("additional_fields"))
    headers = ["Date", "Details", "Withdrawals", "Deposits", "Balance", "Branch"]
    mapping = {"transaction_date": 0, "description": 1, "debit_amount": 2, "credit_amount": 3, "running_balance": 4}
    t = tx.withColumn("transaction_date", F.lit(""))
    targets = ["Particulars", "Withdrawal", "Cr", "Cum Balance", "Branch"]
    flat = export.flat_table(t, targets, {"Particulars": "Details", "Cr": "Deposits"}, headers, mapping)
    return flat.withColumn("Dr/Cr", F.when(F.col("Withdrawal") > 0, F.col("Withdrawal")).otherwise(F.col("Cr")))


@query(f"""WITH {_ledger_sql(False)} SELECT statement_id::VARCHAR AS doc_id, 0::BIGINT AS ord, CASE WHEN statement_id % 2 = 0 THEN 'Doc Date|Debit / Credit|Balance' ELSE 'Narration detail|Branch' END AS line FROM bounds
    UNION ALL SELECT statement_id::VARCHAR, seq + 1, CASE WHEN statement_id % 2 = 0 THEN 'd' || seq || '|' || printf('%.2f', CASE WHEN debit > 0 THEN debit ELSE credit END / 100) || '|' || printf('%.2f', balance / 100) ELSE 'e' || event_id || '|x' || event_id END FROM ledger""")
def flat_sheets(spark, sf_dir):
    """Flat tables of all statements at once, each under its own target headers; a row that moves nothing is a credit of 0."""
    rows, bounds = events_ledger(spark, sf_dir)
    amount = lambda c: F.when(F.col(c) > 0, F.col(c) / 100)
    e = F.col("event_id").cast("string")
    tx = rows.select(
        "statement_id", "seq", F.concat(F.lit("d"), F.col("seq").cast("string")).alias("transaction_date"), F.concat(F.lit("e"), e).alias("description"), amount("debit").alias("debit_amount"), F.when(F.col("debit") == 0, F.col("credit") / 100).alias("credit_amount"), (F.col("balance") / 100).alias("running_balance"),
        F.lit("clean").alias("status"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("5"), F.concat(F.lit("x"), e)).alias("additional_fields"), *[F.lit(None).cast("double").alias(f"universal_{c}") for c in ("debit", "credit", "balance")],
    )
    mapping = F.create_map(*[F.lit(x) for i, f in enumerate(K.FIELDS) for x in (f, i)])
    info = bounds.select("statement_id", F.array(*map(F.lit, ["Date", "Details", "Withdrawals", "Deposits", "Balance", "Branch"])).alias("headers"), mapping.alias("mapping"))
    names = F.when(F.col("statement_id") % 2 == 0, F.array(F.lit("Doc Date"), F.lit("Debit / Credit"), F.lit("Balance"))).otherwise(F.array(F.lit("Narration detail"), F.lit("Branch")))
    targets = bounds.select("statement_id", F.posexplode(names).alias("ord", "target"))
    return report.flat_rows(tx, targets, info).select(F.col("doc_id").cast("string").alias("doc_id"), "ord", F.array_join("cells", "|").alias("line"))


_CORRECTED_SQL = f"""{_SEEN}, c AS (SELECT statement_id, seq, CASE WHEN statement_id % 2 = 0 THEN balance - CASE WHEN event_id % 97 = 0 THEN {OFFSET} ELSE 0 END ELSE balance END AS balance, debit, credit, status FROM valid),
    s AS (SELECT statement_id, count(*) FILTER (WHERE status <> 'clean') > 0 AS hit, count(*) AS n, count(*) FILTER (WHERE status <> 'clean') AS bad FROM valid GROUP BY 1)
    SELECT statement_id, round(CASE WHEN hit AND statement_id % 2 = 0 THEN 1.0 ELSE (n - bad * 0.5) / n END, 6)::DOUBLE AS confidence, hit AND statement_id % 2 = 1 AS review_required, false AS flagged FROM s"""


def _corrected(spark, sf_dir, times, stored=False):
    rows, bounds = events_ledger(spark, sf_dir, True)
    rows = rows.select("statement_id", "seq", "event_id", *[(F.col(c) * times).alias(c) for c in ("debit", "credit", "balance")])
    bounds = bounds.select("statement_id", *[(F.col(c) * times).alias(c) for c in ("opening", "closing")])
    judged = keep(ledger.triage(ledger.validate(rows, bounds)), "judged")  # read by statements and rows
    amount = lambda c: F.when(F.col(c) > 0, F.col(c) / 100)
    empty = F.create_map(F.lit("9"), F.lit("x"))
    tx = judged.select("statement_id", "seq", F.lit("01/02/2024").alias("transaction_date"), F.lit("").alias("description"), amount("debit").alias("debit_amount"), amount("credit").alias("credit_amount"), (F.col("balance") / 100).alias("running_balance"), F.col("triage").alias("status"), "confidence", empty.alias("additional_fields"), *[F.lit(None).cast("double").alias(f"universal_{c}") for c in ("debit", "credit", "balance")])
    state = judged.groupBy("statement_id").agg(F.avg("confidence").alias("confidence"), F.bool_or(F.col("triage") != "clean").alias("review_required"))
    headers = F.array(*map(F.lit, ["Date", "Details", "Debit", "Credit", "Cum Bal"]))
    s = bounds.join(state, "statement_id").select("statement_id", (F.col("opening") / 100).alias("opening"), (F.col("closing") / 100).alias("closing"), F.lit(1.0).alias("rate"), headers.alias("headers"), F.create_map(*[F.lit(x) for i, f in enumerate(K.FIELDS) for x in (f, i)]).alias("mapping"), "confidence", "review_required", F.array().cast("array<string>").alias("anomaly_flags"))
    right = rows.filter((F.col("event_id") % 97 == 0) & (F.col("statement_id") % 2 == 0)).select("statement_id", "seq", F.lit("Cum Balance").alias("key"), F.format_string("%.2f", (F.col("balance") - OFFSET * times) / 100).alias("value"))
    # a new description changes no account that is right otherwise
    right = right.unionByName(rows.filter("seq = 1 AND statement_id % 4 = 0").select("statement_id", "seq", F.lit("Details").alias("key"), F.lit("noted").alias("value")))
    none = spark.createDataFrame([], repair.LOG), spark.createDataFrame([], "statement_id long, page int, row int, raw_text string, reason string, review_required boolean")
    first = corrections.Stored(s, tx, *none)
    if stored:  # written, corrected where it lies, and read again
        kept = generations.Store.create(spark, f"{shared_dir(spark)}/ledgers-{uuid.uuid4().hex}", buckets=16)
        kept.append(first)
        kept.correct(right)
        done = kept.read()
    else:
        done = corrections.correct(first, right)
    return done.statements.select("statement_id", F.round("confidence", 6).alias("confidence"), "review_required", (F.size("anomaly_flags") > 0).alias("flagged"))


@query(_CORRECTED_SQL)
def correct_statements(spark, sf_dir):
    """Accounts with wrong balances; those of even users are corrected, judged anew, and need no review any more."""
    return _corrected(spark, sf_dir, 1)


@query(_CORRECTED_SQL)
def stored_corrections(spark, sf_dir):
    """The same in stored tables: the corrected statements' buckets are rewritten, all others stay."""
    return _corrected(spark, sf_dir, 1, stored=True)


@query(_CORRECTED_SQL)
def correct_large_statements(spark, sf_dir):
    """The same with amounts of up to some billions."""
    return _corrected(spark, sf_dir, 1_000_000)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '0,0' ELSE '0,0;0,1;1,0' END AS cells FROM orders")
def traversal_recovery(spark, sf_dir):
    """Traversals that deviate are asked for again; every fifth gets no answer and keeps what was right."""
    k, want = F.col("id") % 5, F.array(F.lit("0,0"), F.lit("0,1"), F.lit("1,0"))
    got = F.when(k == 0, want).when(k == 1, F.array(F.lit("0,0"), F.lit("9,9"))).when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("0,0"), F.lit("0,1"), F.lit("1,1"))).otherwise(F.array(F.lit("0,0"), F.lit("x")))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select("id", want.alias("expected"), got.alias("generated"))
    out = header.recover(t, lambda q: q.filter("id % 5 <> 4").select("id", F.slice(want, F.size("prefix") + 1, F.lit(2)).alias("suffix")))
    return out.select(F.col("id").alias("o_orderkey"), F.array_join("generated", ";").alias("cells"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 0 END AS n_flags, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS owner FROM orders")
def stored_json(spark, sf_dir):
    """Stored JSON texts; broken and absent ones are empty."""
    k = F.col("o_orderkey") % 3
    flags = F.when(k == 0, F.to_json(F.array("o_orderstatus", "o_orderpriority"))).when(k == 1, "[broken")
    fields = F.when(k == 1, F.to_json(F.create_map(F.lit("owner"), F.col("o_custkey"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(T.parsed_json(flags, "array<string>")).alias("n_flags"), F.try_element_at(T.parsed_json(fields, "map<string,bigint>"), F.lit("owner")).alias("owner"))


@query(r"""SELECT o_orderkey, name, contains(name, '/') AND o_orderkey % 5 NOT IN (2, 3) AS combined FROM (SELECT o_orderkey,
    CASE o_orderkey % 5 WHEN 0 THEN 'Dr/Cr' WHEN 1 THEN 'Debit / Credit' WHEN 2 THEN 'Debit' WHEN 3 THEN substr(o_orderpriority, 1, 1) || '/B' ELSE 'Withdrawal/Deposit' END AS name FROM orders)""")
def combined_header(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "Dr/Cr").when(k == 1, "Debit / Credit").when(k == 2, "Debit").when(k == 3, F.concat(F.substring("o_orderpriority", 1, 1), F.lit("/B"))).otherwise("Withdrawal/Deposit")
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", "name", export.combined_header(F.col("name")).alias("combined"))


# ---------------------------------------------------------------- store


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def statement_list(spark, sf_dir):
    return store.statement_list(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def statement_latest(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 5).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, len(c)::INTEGER AS n, coalesce(list_sum(list_transform(c, lambda x: x))::BIGINT, 0) AS total, coalesce(c[1], -1) AS first FROM orders LEFT JOIN
    (SELECT l_orderkey, list(CAST(round(l_extendedprice * 100) AS BIGINT) ORDER BY l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""".replace("len(c)::INTEGER", "coalesce(len(c), 0)::INTEGER").replace("list_transform(c, lambda x: x)", "c"))
def statement_detail(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    s = store.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "cents"], "lines")
    cents = F.transform("lines", lambda x: x["cents"])
    return s.select("o_orderkey", F.size("lines").alias("n"), F.aggregate(cents, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.coalesce(F.get(cents, F.lit(0)), F.lit(-1).cast("long")).alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def apply_corrections(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return store.apply_corrections(o, o.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"], ["o_orderstatus"])


@query(f"""WITH {_ledger_sql(True)}, {_SIGNS_SQL}, {_VALID_SQL} SELECT statement_id, count(*) FILTER (WHERE status = 'flagged') AS flagged FROM valid WHERE statement_id % 10 = 0 GROUP BY 1""")
def revalidate_touched(spark, sf_dir):
    rows, bounds = events_ledger(spark, sf_dir, True)
    fixes = bounds.filter("statement_id % 10 = 0").select("statement_id")
    v = ledger.validate(store.touched(rows, fixes, "statement_id"), bounds)
    return v.groupBy("statement_id").agg(F.count_if(F.col("status") == "flagged").alias("flagged"))


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 50)")
def delete_logs(spark, sf_dir):
    return store.delete_where(table(spark, sf_dir, "events"), (F.col("event_type") == "error") & (F.col("value") > 50)).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.delete_cascade(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS flagged FROM customer")
def review_exists(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return store.flag_existing(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey")


@query("SELECT r_regionkey, r_name, NULL::DOUBLE AS exchange_rate FROM region")
def schema_upgrade(spark, sf_dir):
    return store.upgrade(table(spark, sf_dir, "region"), {"exchange_rate": "double"})


# ---------------------------------------------------------------- layout and profile

CENTRES = [5.0, 15.0, 25.0, 35.0, 45.0]


@query(f"SELECT p_partkey, (list_position(a, list_min(a)) - 1)::INTEGER AS col FROM (SELECT p_partkey, list_transform({CENTRES}::DOUBLE[], lambda c: abs(c - p_size)) AS a FROM part)")
def nearest_column(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", layout.nearest(F.col("p_size").cast("double"), F.array(*map(F.lit, CENTRES))).alias("col"))


def _laid_out(grid: DataFrame) -> DataFrame:
    """Tables of sheets laid out by position (columns 100 points apart, lines 12 points apart) and made from their words."""
    g = grid.filter((F.col("row") >= 5) & (F.col("row") < 1_000_000))
    c = g.select("doc_id", "page", "row", F.posexplode("cells").alias("col", "text")).filter("text <> ''")
    w = Window.partitionBy("doc_id", "page").orderBy("row", "col")
    words = c.select("doc_id", "page", F.row_number().over(w).alias("word_idx"), "text", (F.col("col") * 100.0).alias("x0"), (F.col("col") * 100.0 + 40).alias("x1"), (F.col("row") * 12.0 + F.col("col") % 2).alias("top"))
    return layout.grid_from_words(words)


@query(f"{_SHEET_LINES} SELECT k::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY row) - 1)::INTEGER AS row, array_to_string(cells, '|') AS line FROM lines WHERE row >= 5 AND row < 1000000")
def grid_from_words(spark, sf_dir):
    """Every cell of every sheet is back in its place."""
    return _laid_out(statement_grids(spark, sf_dir)).select("doc_id", F.col("row").cast("int").alias("row"), F.array_join("cells", "|").alias("line"))


@query("SELECT o_custkey::VARCHAR AS doc_id, count(*) + 1 AS n_rows, 5 AS width FROM orders GROUP BY 1")
def grid_from_words_all(spark, sf_dir):
    """How large every sheet is."""
    return _laid_out(statement_grids(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("width"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'full_pipeline_fallback' ELSE 'digital_text_borderless_table' END WHEN 1 THEN 'digital_text_simple_table' WHEN 2 THEN 'digital_text_borderless_table' ELSE 'irregular_or_merged_cells' END AS route,
    page_id % 4 = 0 AND page_id % 9 > 5 AS retrieval, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'bordered' ELSE 'borderless' END WHEN 2 THEN 'borderless' ELSE 'bordered' END AS table_border_type, 'ambiguous' AS date_format_locale,
    CASE page_id % 4 WHEN 0 THEN greatest(page_id % 9, 1) WHEN 3 THEN 0 ELSE 1 END::INTEGER AS n_roles FROM pages""")
def profile_route(spark, sf_dir):
    k = F.col("page_id") % 4
    ext = F.when(k == 0, ".pdf").when(k == 1, ".xlsx").when(k == 2, ".csv").otherwise(".txt")
    files = table(spark, sf_dir, "pages").select("page_id", F.concat("url", ext).alias("path"), (F.col("page_id") % 9).cast("int").alias("n_pages"), F.lit(True).alias("has_text"), (F.col("page_id") % 8 == 0).alias("has_tables"))
    p = profile.profile(files)
    way = profile.route(F.col("text_layer_present"), F.col("table_border_type"), F.col("layout_complexity"), F.col("merged_cell_density"), F.col("language"), F.col("header_structure"))
    roles = F.size("page_role_estimate").alias("n_roles")
    return p.select("page_id", way.alias("route"), profile.needs_retrieval(F.col("page_count")).alias("retrieval"), "table_border_type", "date_format_locale", roles)


@query("SELECT conv_id, turn, CASE WHEN rn = 1 AND n > 1 THEN 'cover' ELSE 'transaction_table' END AS role FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def page_roles(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("rn"), F.count("*").over(w).alias("n"))
    return c.select("conv_id", "turn", profile.page_role(F.col("rn"), F.col("n")).alias("role"))
