"""Where a table's header is, and which column holds which field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import alias_field, field_of_low, field_of_normal, header_like, headers_match_by_meaning, headers_match_fuzzily, infer_field, is_anchor, map_header, maybe_dated, maybe_header_like, merge_headers, normalize_header, squeeze, strip
from ..lineage import keep, once
from .grouping import column_of
from .vectors import Index
from .vendor import INLINE


def scored_fields(cells: F.Column) -> F.Column:
    """(field, s, col) of each header cell that has a field: an alias scores 1.0, inferred terms 0.85; s is negative."""
    return scored_spellings(_spelled(cells))


def scored_spellings(spelled: F.Column) -> F.Column:
    """scored_fields() of cells whose spellings are made already."""
    named = F.filter(spelled, lambda x: x["exact"].isNotNull() | x["inferred"].isNotNull())
    return F.transform(named, lambda x: F.struct(F.coalesce(x["exact"], x["inferred"]).alias("field"), F.when(x["exact"].isNotNull(), -1.0).otherwise(-0.85).alias("s"), x["col"].alias("col")))


def best_columns(scored: F.Column, fields: list[str]) -> F.Column:
    """field -> its best-scoring column, the first on ties; scored: array of (field, s, col)."""
    best = lambda f: F.array_min(F.transform(F.filter(scored, lambda x: x["field"] == f), lambda x: F.struct(x["s"], x["col"])))["col"]
    entries = [F.struct(F.lit(f).alias("key"), best(f).cast("int").alias("value")) for f in fields]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def map_columns(headers: DataFrame, keys: list[str]) -> DataFrame:
    """keys and mapping (field -> column) of rows of header cells, without a model; rows without any field are left out.

    headers: keys, cells. A field goes to its best column, the first on ties. All within a row: nothing is shuffled.
    """
    scored = once(headers.select(*keys, "cells"), scored=scored_fields(F.col("cells"))).filter(F.size("scored") > 0)
    return scored.select(*keys, best_columns(F.col("scored"), sorted(K.FIELDS)).alias("mapping"))


def _qualifies(m: str) -> F.Column:
    has = lambda f: F.coalesce(F.map_contains_key(m, f), F.lit(False))
    return has("transaction_date") & (has("description") | has("debit_amount") | has("credit_amount") | has("running_balance"))


def _with_description(m: F.Column, width: F.Column) -> F.Column:
    """The first column that no field has becomes the description where none is mapped."""
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), F.map_values(m)))
    return F.when(F.map_contains_key(m, "description") | free.isNull(), m).otherwise(F.map_concat(m, F.create_map(F.lit("description"), free)))


def _with_balance(m: F.Column, cells: F.Column) -> F.Column:
    """An unmapped balance goes to the first cell that resembles one."""
    at = F.array_position(F.transform(cells, lambda c: headers_match_fuzzily(c, F.lit("balance"))), True) - 1
    return F.when(F.map_contains_key(m, "running_balance") | (at < 0), m).otherwise(F.map_concat(m, F.create_map(F.lit("running_balance"), at.cast("int"))))


def registered_columns(columns: DataFrame) -> DataFrame:
    """vendor_key and its registered headers in their order: (field, header, squeezed, inferred)."""
    c = columns.select("vendor_key", "ord", "field", "header", squeeze(strip(F.col("header"))).alias("squeezed"), field_of_normal(normalize_header(F.col("header"))).alias("inferred"))
    return c.groupBy("vendor_key").agg(F.array_sort(F.collect_list(F.struct("ord", "field", "header", "squeezed", "inferred"))).alias("wanted"))


def _spelled(cells: F.Column) -> F.Column:
    """squeezed, inferred, exact (the field that has it as an alias) and col of each cell: each pattern is tried once."""
    normal = F.transform(cells, lambda c, i: F.struct(F.lower(strip(F.coalesce(c, F.lit("")))).alias("low"), normalize_header(c).alias("n"), i.alias("col")))
    return F.transform(normal, lambda x: F.struct(F.replace(x["n"], F.lit(" "), F.lit("")).alias("squeezed"), field_of_normal(x["n"]).alias("inferred"), field_of_low(x["low"]).alias("exact"), x["col"].alias("col")))


def _score(cell: F.Column, wanted: F.Column) -> F.Column:
    """header_score() of spellings that are made already."""
    x, y = cell["squeezed"], wanted["squeezed"]
    same = F.coalesce(cell["inferred"] == wanted["inferred"], F.lit(False))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.85).when(same, 0.6).otherwise(0.0)


def _vendor_matches(wanted: F.Column, spelled: F.Column) -> F.Column:
    """(field, score, col) of each registered header with a cell that scores: its best cell, the first on ties."""
    best = lambda w: F.array_min(F.transform(spelled, lambda c: F.struct((-_score(c, w)).alias("s"), c["col"].alias("col"))))
    found = F.transform(wanted, lambda w: F.struct(w["field"].alias("field"), best(w).alias("b")))
    return F.transform(F.filter(found, lambda x: x["b"]["s"] < 0), lambda x: F.struct(x["field"].alias("field"), (-x["b"]["s"]).alias("score"), x["b"]["col"].cast("int").alias("col")))


def _as_map(found: str) -> F.Column:
    return F.map_from_entries(F.transform(found, lambda x: F.struct(x["field"].alias("key"), x["col"].alias("value"))))


def _inline(rows: DataFrame, columns: DataFrame, vendors: DataFrame) -> DataFrame:
    """at, own_key, own_map of the best vendor (the first on ties) of rows whose cells fit its headers with a mean of
    INLINE: of four headers or more, the date and all but one are matched (three at least).

    Such a mean needs two thirds of the headers spelled alike, so equal spellings find all candidates: no row meets a
    vendor that it shares no header with.
    """
    sizes = columns.groupBy("vendor_key").agg(F.count("*").alias("n")).filter("n >= 4")
    names = columns.join(sizes, "vendor_key").select("vendor_key", "n", squeeze(strip(F.col("header"))).alias("squeezed"), "field").filter("squeezed <> ''")
    shown = rows.select("at", F.explode(F.array_distinct(F.transform("spelled", lambda c: c["squeezed"]))).alias("squeezed"))
    met = shown.join(names, "squeezed").groupBy("at", "vendor_key").agg(F.count("*").alias("same"), F.first("n").alias("n")).filter(F.col("same") * 3 >= F.col("n") * 2)
    tried = rows.join(met, "at").join(registered_columns(columns), "vendor_key").join(vendors.select("vendor_key", F.col("ord").alias("vendor_ord")), "vendor_key")
    tried = once(tried, found=_vendor_matches(F.col("wanted"), F.col("spelled"))).filter(F.exists("found", lambda x: x["field"] == "transaction_date") & (F.size("found") >= F.greatest(F.lit(3), F.col("n") - 1)))
    mean = F.aggregate("found", F.lit(0.0), lambda s, x: s + x["score"]) / F.col("n")
    tried = tried.withColumn("mean", F.round(mean, 9)).filter(F.col("mean") >= INLINE).withColumn("mapping", _as_map("found"))
    full = _with_description(_with_balance(F.col("mapping"), F.col("cells")), F.size("cells"))
    return tried.groupBy("at").agg(F.min(F.struct((-F.col("mean")).alias("m"), "vendor_ord", "vendor_key")).alias("b"), F.collect_list(F.struct("vendor_key", F.map_entries(full).alias("entries"))).alias("maps")).select(
        "at", F.col("b.vendor_key").alias("own_key"), F.map_from_entries(F.get(F.filter("maps", lambda x: x["vendor_key"] == F.col("b.vendor_key")), F.lit(0))["entries"]).alias("own_map")
    )


def locate(grid: DataFrame, known: DataFrame | None = None, registry: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc_id, page, row, start_row (of the body), headers, mapping and vendor_key of the first header of each document.

    Rows are tried in their order, and on each: the headers of the document's vendor (known: doc_id, vendor_key), or of
    any registered vendor where it has none; then the row alone; then, if it has only some of what a header needs, the
    row with the one below. registry: vendors, columns. Where the row below a header has text and no date, both are one
    header and are mapped anew; a vendor's headers are then compared by meaning.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("row")
    named = lambda c: F.exists(c, lambda x: header_like(strip(x)))
    if registry is None:  # without a date no row is a header, alone or with the one below: only rows beside one are looked at
        lined = once(grid.select("doc_id", "page", "row", "cells"), line=F.lower(F.array_join("cells", " ")))
        rows = lined.withColumn("dated", maybe_dated(F.col("line"))).drop("line")
        rows = rows.select("*", F.lead("cells").over(w).alias("below"), F.lead("dated").over(w).alias("dated_below"))
        rows = once(rows.filter(F.col("dated") | F.col("dated_below")).drop("dated", "dated_below"), like=named("cells")).filter("like").drop("like")
    else:
        rows = once(grid.select("doc_id", "page", "row", "cells"), like=F.when(maybe_header_like(F.col("cells")), named("cells")))
        rows = rows.withColumn("below", F.lead("cells").over(w)).filter("like").drop("like")
    rows = once(rows.select("*", F.struct("doc_id", "page", "row").alias("at")), spelled=_spelled(F.col("cells")))
    rows = once(once(rows, scored=scored_spellings(F.col("spelled"))), single=best_columns(F.col("scored"), sorted(K.FIELDS))).drop("scored")
    both = merge_headers(F.col("cells"), F.col("below"))
    part = F.map_contains_key("single", "transaction_date") | F.map_contains_key("single", "description")
    if registry is None:
        rows = rows.filter(part)  # no other row is a header, alone or with the one below
    # what is merged counts only where the row has a part of a header: a vendor's own header is compared by itself
    rows = rows.withColumn("alone", _qualifies("single"))
    rows = once(rows, scored_both=F.when(part & ~F.col("alone"), scored_fields(both)))
    rows = once(rows, merged=best_columns(F.col("scored_both"), sorted(K.FIELDS))).drop("scored_both")
    rows = rows.withColumn("together", _qualifies("merged") & part)
    if registry is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("vendor_key"), F.lit(None).cast("map<string,int>").alias("own_map"), F.lit(None).cast("array<struct<ord:int,field:string,header:string>>").alias("wanted"))
    else:
        vendors, columns = registry
        wide = registered_columns(columns)
        # three steps read the candidates: the grid is looked through for them once
        rows = keep(rows.join(known, "doc_id", "left").withColumnRenamed("vendor_key", "known_key"), "candidate-rows")
        inline = _inline(rows.filter("known_key IS NULL"), columns, vendors)
        rows = rows.join(inline, "at", "left").withColumn("vendor_key", F.coalesce("known_key", "own_key")).join(wide, "vendor_key", "left")
        rows = once(rows, found=F.when(F.col("known_key").isNotNull(), _vendor_matches(F.col("wanted"), F.col("spelled")))).withColumn("known_map", _as_map("found"))
        filled = F.when(_qualifies("known_map"), _with_description(_with_balance(F.col("known_map"), F.col("cells")), F.size("cells")))
        rows = once(rows.withColumnRenamed("own_map", "inline_map"), own_map=F.coalesce("inline_map", filled))
    found = rows.filter(F.col("own_map").isNotNull() | F.col("alone") | F.col("together"))
    first = F.min_by(F.struct("page", "row", "cells", "below", "single", "merged", "alone", "vendor_key", "own_map", "wanted"), F.struct("page", "row"))
    found = once(found.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.*"), both=both)
    own = F.col("own_map").isNotNull()
    taken = F.coalesce("own_map", F.when(F.col("alone"), _with_description(F.col("single"), F.size("cells"))).otherwise(_with_description(F.col("merged"), F.size("both"))))
    found = found.withColumn("mapping", taken).withColumn("two", ~own & ~F.col("alone"))
    date = F.coalesce(is_anchor(F.get("below", column_of("transaction_date"))), F.lit(False))
    text = F.exists(F.coalesce("below", F.array().cast("array<string>")), lambda c: strip(c) != "")
    found = once(found.withColumn("split", text & ~date), scored_both=F.when(F.col("split") & F.col("alone") & F.col("vendor_key").isNull(), scored_fields(F.col("both"))))
    found = found.withColumn("merged", F.when(F.col("alone"), best_columns(F.col("scored_both"), sorted(K.FIELDS))).otherwise(F.col("merged"))).drop("scored_both")
    at = lambda h: F.array_position(F.transform("both", lambda c: F.coalesce(headers_match_by_meaning(c, h), F.lit(False))), True)
    meant = F.filter(F.transform("wanted", lambda v: F.struct(v["field"].alias("key"), (at(v["header"]) - 1).cast("int").alias("value"))), lambda e: e["value"] >= 0)
    again = F.when(F.col("vendor_key").isNotNull(), F.map_from_entries(meant)).otherwise(F.col("merged"))
    found = found.withColumn("mapping", F.when(F.col("split"), again).otherwise(F.col("mapping")))
    both = F.col("two") | F.col("split")
    return found.select("doc_id", "page", "row", (F.col("row") + F.when(both, 2).otherwise(1)).alias("start_row"), F.transform(F.when(both, F.col("both")).otherwise(F.col("cells")), strip).alias("headers"), "mapping", "vendor_key")


def deviation(expected: F.Column, generated: F.Column) -> F.Column:
    """0-based place of the first cell of a traversal that is not the expected one (or is missing); -1 without one."""
    wrong = F.array_position(F.zip_with(expected, F.slice(generated, F.lit(1), F.greatest(F.size(expected), F.lit(1))), lambda e, g: F.coalesce(e == g, F.lit(False)) | e.isNull()), False)
    return (wrong - 1).cast("int")


def recover(traversals: DataFrame, ask: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """id and generated of traversals (id, expected, generated: arrays of 'row,col') after up to so many attempts.

    Each attempt cuts the sequences that deviate at their first wrong cell and asks for the rest: ask gets (id, prefix,
    next: the cell expected there) and returns (id, suffix). Only sequences that still deviate are asked for again.
    """
    done = None
    open_ = keep(traversals.select("id", "expected", "generated"), "traversals")
    for _ in range(attempts):
        marked = open_.withColumn("at", deviation(F.col("expected"), F.col("generated")))
        good = marked.filter("at < 0").select("id", "generated")
        done = good if done is None else done.unionByName(good)
        wrong = marked.filter("at >= 0").withColumn("prefix", F.slice("generated", F.lit(1), F.col("at")))
        answers = ask(wrong.select("id", "prefix", F.get("expected", F.col("at")).alias("next")))
        open_ = keep(wrong.join(answers, "id", "left").select("id", "expected", F.concat("prefix", F.coalesce("suffix", F.array().cast("array<string>"))).alias("generated")), "traversals")
    return open_.select("id", "generated") if done is None else done.unionByName(open_.select("id", "generated"))


def anchors(vectors: DataFrame) -> DataFrame:
    """field, vector of the canonical aliases, from any model's vectors (text, vector)."""
    spark = vectors.sparkSession
    aliases = spark.createDataFrame([(f, i, a) for i, (f, al) in enumerate(K.HEADER_ALIASES.items()) for a in al], "field string, field_ord int, text string")
    return aliases.join(vectors, "text").select("field", "field_ord", "vector")


#: Cosine from which a vector names one header's field, and score from which a column may take a field.
ALONE, CANDIDATE = 0.75, 0.70


def map_header_by_vectors(headers: DataFrame, vectors: DataFrame, known: DataFrame) -> DataFrame:
    """header, field, score of distinct headers: an alias 1.0, else the nearest anchor at ALONE or above, else inferred terms,
    else containment (0.8 both). vectors: text, vector; known: anchors()."""
    texts = headers.select("header").distinct()
    index = Index(known.select(F.struct("field_ord", "field").alias("name"), "vector"))
    near = index.nearest(_vectors_of(texts, vectors)).select(F.col("id").alias("header"), F.struct("name.field", "score").alias("near"))
    rows = once(texts.join(near, "header", "left"), m=map_header(F.col("header")))
    exact = F.col("m.score") == 1.0
    taken = F.when(exact | (F.trim("header") == ""), F.col("m")).when(F.col("near.score") >= ALONE, F.col("near")).otherwise(F.col("m"))
    return rows.select("header", taken.alias("t")).select("header", "t.field", "t.score")


def _vectors_of(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and vector of the headers that have a vector."""
    return texts.join(vectors.select(F.col("text").alias("header"), "vector"), "header").select(F.col("header").alias("id"), "vector")


def map_columns_by_vectors(headers: DataFrame, keys: list[str], vectors: DataFrame, known: DataFrame) -> DataFrame:
    """keys and mapping of rows of header cells: aliases (1.0), else cosines of all fields; and inferred terms (0.85); those of
    CANDIDATE or more, best first, take a field and a column that are both free (ties: the column, then as listed)."""
    cells = headers.select(*keys, F.posexplode("cells").alias("col", "header")).filter(F.trim("header") != "")
    texts = cells.select("header").distinct()
    exact = texts.withColumn("field", alias_field(F.col("header"))).filter("field IS NOT NULL").select("header", "field", F.lit(1.0).alias("score"), F.lit(0).alias("kind"))
    index = Index(known.select(F.struct("field_ord", "field").alias("name"), "vector"))
    near = index.within(_vectors_of(texts.join(exact.select("header"), "header", "left_anti"), vectors), CANDIDATE).select(F.col("id").alias("header"), "name.field", "score", (F.col("name.field_ord") + 1).alias("kind"))
    said = texts.join(exact.select("header"), "header", "left_anti").withColumn("field", infer_field(F.col("header"))).filter("field IS NOT NULL").select("header", "field", F.lit(0.85).alias("score"), F.lit(9).alias("kind"))
    found = cells.join(exact.unionByName(near).unionByName(said), "header")
    listed = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "col", "kind", "field"))), lambda x: F.struct(x["field"].alias("key"), x["col"].alias("value"))).alias("c"))
    empty = F.array().cast("array<struct<key:string,value:int>>")
    free = lambda held, x: ~F.exists(held, lambda h: (h["key"] == x["key"]) | (h["value"] == x["value"]))
    taken = F.aggregate("c", empty, lambda held, x: F.when(free(held, x), F.concat(held, F.array(x))).otherwise(held))
    return listed.select(*keys, F.map_from_entries(taken).alias("mapping"))
