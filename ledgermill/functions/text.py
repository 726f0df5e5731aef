"""Column functions for statement text: amounts, dates, headers, masking. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def strip(c: Column) -> Column:
    """Without white space at either end (trim() alone knows only spaces)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def occurrences(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


# ---------------------------------------------------------------- amounts


def parse_currency(c: Column, locale: str | Column = "period_decimal") -> Column:
    """The amount in a cell as double; 0 for what is no amount (dates, several signs, no digits).

    Parentheses negate. In locale comma_decimal the comma is the decimal sign and dots group digits.
    """
    comma = F.lit(locale) == "comma_decimal" if isinstance(locale, str) else locale == "comma_decimal"
    s = strip(F.coalesce(c, F.lit("")))
    wrapped = s.startswith("(") & s.endswith(")")
    inner = F.when(wrapped, F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s)
    kept = F.regexp_replace(inner, r"[^0-9.,-]", "")
    plain = F.when(comma, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    refused = s.contains("/") | (occurrences(s, "-") > 1) | F.when(comma, occurrences(s, ",") > 1).otherwise(occurrences(s, ".") > 1)
    return F.coalesce(F.when(refused, F.lit(0.0)).when(wrapped, -F.abs(value)).otherwise(value), F.lit(0.0))


def plain_number(c: Column) -> Column:
    """A double's digits without an exponent, as parse_currency() reads them; null stays null."""
    written = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when(F.abs(c).between(1e-3, 9_999_999.0) | (c == 0), c.cast("string")).when(c.isNotNull(), F.coalesce(written, F.format_string("%.1f", c)))


def to_units(amount: Column, scale: int = 100) -> Column:
    """Whole units (cents by default) of an amount, so that sums are exact."""
    return F.round(amount * scale).cast("long")


def close_to(a: Column, b: Column, scale: int = 100) -> Column:
    """|a - b| <= 0.01 + 0.00001 |b| in whole units; b is the reference side."""
    return F.abs(a - b) * 100_000 <= F.lit(1000 * scale) + F.abs(b)


def close_to_double(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.01 + 1e-5 * F.abs(b)


def optional_amount(raw: Column, locale: str | Column = "period_decimal") -> Column:
    """Null for an empty cell and for a bare zero ('0', '0.0'); '0.00' stays 0."""
    return F.when(F.coalesce(raw, F.lit("")).isin("", "0", "0.0"), F.lit(None).cast("double")).otherwise(parse_currency(raw, locale))


def rounded_cents(x: Column) -> Column:
    """A double rounded to two decimals by its exact binary value, ties to the even cent: what decimal arithmetic without
    error gives. From 45 trillion on, where doubles have few decimals left, it stays as it is."""
    # x * 100 is product + rest without error: the halves of x times 100 are exact
    wide = x * 134217729.0
    high = wide - (wide - x)
    product = x * 100.0
    rest = (high * 100.0 - product) + (x - high) * 100.0
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(whole, F.lit(2)) == 1))))
    return F.when(F.abs(product) < 4.5e15, (whole + F.when(up, 1).otherwise(0)) / 100.0).otherwise(x)


def convert(amount: Column, rate: Column) -> Column:
    """An amount in another currency, to cents; null stays null."""
    return rounded_cents(amount * rate)


def candidates(raw: Column) -> Column:
    """Readings that a misread amount may stand for, in order: confused characters, swapped digits, moved points."""
    s = strip(raw)
    digits = F.regexp_replace(s, r"[^0-9]", "")

    def places(n: Column, f) -> Column:
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast("array<string>"))

    def confused(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        d = F.translate(c, K.CONFUSED, K.DIGITS)
        return F.when(c != d, F.concat(F.substring(s, F.lit(1), i - 1), d, F.substring(s, i + 1, F.length(s))))

    def swapped(i: Column) -> Column:
        a, b = F.substring(s, i, F.lit(1)), F.substring(s, i + 1, F.lit(1))
        return F.when(a.rlike("^[0-9]$") & b.rlike("^[0-9]$") & (a != b), F.concat(F.substring(s, F.lit(1), i - 1), b, a, F.substring(s, i + 2, F.length(s))))

    def moved(i: Column) -> Column:
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - i), F.lit("."), F.substring(digits, F.length(digits) - i + 1, i))

    every = F.concat(places(F.length(s), confused), places(F.length(s) - 1, swapped), places(F.least(F.lit(3), F.length(digits) - 1), moved))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != s) & F.regexp_replace(x, r"[^0-9.-]", "").try_cast("double").isNotNull()))


def fx_rate(original: Column, universal: Column, given: Column, vendor_rate: Column) -> Column:
    """1 for equal currencies, else the given rate; a given rate of 1 yields to the vendor's."""
    return F.when(original == universal, F.lit(1.0)).when(given == 1.0, F.coalesce(vendor_rate, F.lit(1.0))).otherwise(given)


def detect_currency(text: Column, vendor_currency: Column | None = None) -> Column:
    """The vendor's currency, else the first whose marks occur in the text, else USD."""
    out = currency_of(F.lower(text))
    return out if vendor_currency is None else F.coalesce(vendor_currency, out)


def currency_of(low: Column) -> Column:
    """detect_currency() of a text in lower case."""
    out = F.lit("USD")
    for code, marks in reversed(K.CURRENCIES.items()):
        out = F.when(any_of([low.contains(m) for m in marks]), F.lit(code)).otherwise(out)
    return out


# ---------------------------------------------------------------- dates


def is_anchor(c: Column) -> Column:
    """Whether a cell holds a date in one of the accepted spellings."""
    return strip(F.coalesce(c, F.lit(""))).rlike(K.ANCHOR_DATE)


def without_time(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), K.TIME_SUFFIX, ""))


def accepted_date(cells: Column, at: Column) -> Column:
    """The date of a record: its date cell if it is a numeric date, else the first such cell; null without one."""
    own = without_time(F.coalesce(F.get(cells, at), F.lit("")))
    other = F.filter(F.transform(cells, without_time), lambda x: x.rlike(K.ACCEPTED_DATE))
    return F.when(own.rlike(K.ACCEPTED_DATE), own).otherwise(F.get(other, F.lit(0)))


def date_bounds(text: Column) -> Column:
    """First and last date of a text in its own order, if there are two at least; empty strings otherwise."""
    found = F.regexp_extract_all(text, F.lit(K.TEXT_DATE), F.lit(0))
    pick = lambda i: F.when(F.size(found) >= 2, F.element_at(found, i)).otherwise(F.lit(""))
    return F.struct(pick(1).alias("start_date"), pick(-1).alias("end_date"))


# ---------------------------------------------------------------- headers


def normalize_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]", "")


def _terms(terms: list[str]) -> str:
    """A pattern of normalised headers: single words match whole words, phrases anywhere."""
    single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    return "|".join([rf"\b(?:{'|'.join(single)})\b", *phrases])


def infer_field(c: Column) -> Column:
    """The canonical field whose terms a header has; the first field in order wins; null without one."""
    return field_of_normal(normalize_header(c))


def field_of_normal(n: Column) -> Column:
    """infer_field() of what normalize_header() has made of a header."""
    out = F.lit(None).cast("string")
    for field, terms in reversed(K.HEADER_TERMS.items()):
        out = F.when(n.rlike(_terms(terms)), F.lit(field)).otherwise(out)
    return F.when(n != "", out)  # most cells are empty


def alias_field(c: Column) -> Column:
    """The field that has the header among its aliases; null without one."""
    return field_of_low(F.lower(strip(F.coalesce(c, F.lit("")))))


def field_of_low(low: Column) -> Column:
    """alias_field() of a header in lower case without white space at its ends."""
    out = F.lit(None).cast("string")
    for field, aliases in reversed(K.HEADER_ALIASES.items()):
        out = F.when(low.isin(*aliases), F.lit(field)).otherwise(out)
    return F.when(low != "", out)  # most cells are empty


def dictionary_match(c: Column) -> Column:
    """(field, score): 1.0 for an alias, 0.8 where one contains the other and both are longer than 2; null fields else."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    near = F.lit(None).cast("string")
    for field, aliases in reversed(K.HEADER_ALIASES.items()):
        tests = [low.contains(a) | F.lit(a).contains(low) for a in aliases if len(a) > 2]
        near = F.when((F.length(low) > 2) & any_of(tests), F.lit(field)).otherwise(near)
    exact = alias_field(c)
    return F.struct(F.coalesce(exact, near).alias("field"), F.when(exact.isNotNull(), 1.0).when(near.isNotNull(), 0.8).otherwise(0.0).alias("score"))


def map_header(c: Column) -> Column:
    """(field, score) of one header without a model: alias 1.0, terms 0.8, containment 0.8."""
    match, inferred = dictionary_match(c), infer_field(c)
    exact = match["score"] == 1.0
    field = F.when(exact, match["field"]).otherwise(F.coalesce(inferred, match["field"]))
    return F.struct(field.alias("field"), F.when(field.isNull(), 0.0).when(exact, 1.0).otherwise(0.8).alias("score"))


def _comparable(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"\b(no|num)\b", "number"), r"[^a-z0-9]", "")


def headers_match_strictly(a: Column, b: Column) -> Column:
    """Equal, or one contains the other and has three characters at least."""
    x, y = _comparable(a), _comparable(b)
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 3) & y.contains(x)) | ((F.length(y) >= 3) & x.contains(y)))


def headers_match_fuzzily(a: Column, b: Column) -> Column:
    """The same inferred field, a strict match, or an abbreviation on one side and its word on the other."""
    x, y = _comparable(a), _comparable(b)
    short = any_of([(x.contains(k) & y.contains(v)) | (y.contains(k) & x.contains(v)) for k, v in K.HEADER_ABBREVIATIONS.items()])
    same = F.coalesce(infer_field(a) == infer_field(b), F.lit(False))
    return (x != "") & (y != "") & (same | headers_match_strictly(a, b) | short)


def headers_match_by_meaning(a: Column, b: Column) -> Column:
    """Fields decide where both headers have one; else a strict match does."""
    return F.coalesce(infer_field(a) == infer_field(b), headers_match_strictly(a, b))


def header_score(cell: Column, expected: Column) -> Column:
    """1.0 equal, 0.85 containment, 0.6 the same field, else 0."""
    x, y = squeeze(strip(cell)), squeeze(strip(expected))
    same = F.coalesce(infer_field(cell) == infer_field(expected), F.lit(False))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.85).when(same, 0.6).otherwise(0.0)


#: Words that a header row shows beside those that name a field.
SHOWN = ("date", "balance", "amount")


def header_like(c: Column) -> Column:
    """Whether a cell names a field, or resembles 'date', 'balance' or 'amount' as headers_match_fuzzily() compares."""
    parts = sorted({w[i:j] for w in SHOWN for i in range(len(w)) for j in range(i + 3, len(w) + 1)})
    short = [k for k, v in K.HEADER_ABBREVIATIONS.items() if v in SHOWN]
    named = "|".join(_terms(t) for t in K.HEADER_TERMS.values())
    return normalize_header(c).rlike(named) | _comparable(c).rlike(rf"{'|'.join([*SHOWN, *short])}|^(?:{'|'.join(parts)})$")


def maybe_header_like(cells: Column) -> Column:
    """False only for rows none of whose cells is header_like(): two looks at the letters of the whole line, as words
    and without spaces; a sign that no cell has keeps cells apart (true where one has it, or where a cell is null)."""
    sign = "\x01"
    line = F.lower(F.array_join(cells, sign))
    short = [k for k, v in K.HEADER_ABBREVIATIONS.items() if v in SHOWN]
    parts = sorted({w[i:j] for w in SHOWN for i in range(len(w)) for j in range(i + 3, len(w) + 1)})
    letters = F.regexp_replace(line, f"[^a-z{sign}]+", " ")
    words = letters.rlike("|".join(_terms(t) for t in K.HEADER_TERMS.values()))
    shown = F.replace(letters, F.lit(" "), F.lit("")).rlike(rf"{'|'.join([*SHOWN, *short])}|(?:^|{sign})(?:{'|'.join(parts)})(?:$|{sign})")
    return words | shown | (occurrences(line, sign) != F.size(cells) - 1)


def maybe_dated(line: Column) -> Column:
    """False only for rows none of whose cells can name a date's column, alone or joined to another by a space: a few
    looks for letters, without patterns. line: the cells in lower case, joined by spaces."""
    words = [*K.HEADER_TERMS["transaction_date"], *K.HEADER_ALIASES["transaction_date"]]
    # a word of each that lies in as many of them as any does; what holds a shorter mark needs none of its own
    marks = {max(w.split(), key=lambda x: (sum(x in other for other in words), x)) for w in words}
    return any_of([line.contains(m) for m in sorted(marks) if not any(o != m and o in m for o in marks)])


def merge_headers(a: Column, b: Column) -> Column:
    """Two header rows joined by column; a text that is there already (whatever its case) is not added."""

    def joined(x: Column, y: Column) -> Column:
        x, y = strip(F.coalesce(x, F.lit(""))), strip(F.coalesce(y, F.lit("")))
        return F.when(x == "", y).when((y == "") | F.lower(x).contains(F.lower(y)), x).otherwise(F.concat_ws(" ", x, y))

    return F.zip_with(a, b, joined)


# ---------------------------------------------------------------- footers, personal data


def is_footer(line: Column) -> Column:
    low = F.lower(line)
    return any_of([low.contains(p) for p in K.FOOTER_PHRASES]) | (low.contains("page") & low.rlike(K.FOOTER_PAGE))


def scrub(c: Column) -> Column:
    """Masks e-mail addresses, phone numbers, account numbers and names, in this order; plain numbers stay."""
    s = strip(F.coalesce(c, F.lit("")))
    number = F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("$"), F.lit("")).try_cast("double").isNotNull()
    out = F.regexp_replace(s, "(?U)" + K.EMAIL, K.MASKS["email"])
    out = F.regexp_replace(out, K.PHONE, K.MASKS["phone"])
    out = F.regexp_replace(out, K.ACCOUNT_TEXT, "$1" + K.MASKS["account"])
    out = F.regexp_replace(out, K.NAMES, K.MASKS["name"])
    return F.when(number, s).otherwise(out)


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words, and one mark for each date pattern that the text has."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    hits = [F.when(text.rlike(p), F.lit(K.DATE_HIT)) for p in K.PAGE_DATE_PATTERNS]
    return F.concat(words, F.filter(F.array(*hits), lambda x: x.isNotNull()))


def triage_tier(status: Column, confidence: Column) -> Column:
    return F.when((status == "clean") & (confidence >= 0.85), "tier_0_accept").when(status == "clean", "tier_1_accept_flagged").when(status == "auto_repaired", "tier_2_auto_repair").otherwise("tier_3_escalate")


def unparseable(raw_text: Column, source_page: Column, reason: Column) -> Column:
    """A line that a person has to look at."""
    return F.struct(raw_text.alias("raw_text"), source_page.alias("source_page"), reason.alias("reason"), F.lit(True).alias("review_required"))


def parsed_json(c: Column, kind: str) -> Column:
    """A stored JSON text as an array or map; an empty one where the text is null or no such JSON."""
    empty = F.array().cast(kind) if kind.startswith("array") else F.map_from_arrays(F.array(), F.array()).cast(kind)
    return F.coalesce(F.from_json(c, kind), empty)
