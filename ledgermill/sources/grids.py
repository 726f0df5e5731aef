"""Sheets and delimited files as grids (doc_id, page, row, cells): one row a sheet row, all cells stripped strings.

Files come through Spark's binaryFile source, so any store that Spark reads will do; parsing is per file, in Python. A
file that cannot be read is a document without rows, and documents_of() says why; the source skips files of no bytes.
"""

from __future__ import annotations

import csv
import io
import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import discard, keep
from ..operators import layout

GRID = "doc_id string, page int, row int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def csv_rows(content: bytes) -> list[list[str]]:
    """Rows of a delimited file, padded to the widest, empty rows left out."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(content.decode("utf-8", errors="ignore"), newline=""))]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows if any(r)]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str]]:
    """Rows of a workbook's first (or named) sheet as strings, padded to the widest, empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        named = {s.get("name"): s.get(f"{_REL}id") for s in sheets}
        wanted = named[sheet] if sheet else next(iter(named.values()))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        path = targets[wanted].lstrip("/")
        rows = []
        for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    text = ""
                elif kind == "s":
                    text = shared[int(value.text)]
                else:
                    text = value.text
                cells[_column(c.get("r")) if c.get("r") else i] = text.strip()
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows if any(r)]


def _cell(v: object) -> str:
    if v is None or v == "":
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>'


#: Signs that no XML file may hold.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_OFFICE = "http://schemas.openxmlformats.org"


def write_workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A minimal workbook of these sheets; numbers stay numbers."""
    head, n = '<?xml version="1.0" encoding="UTF-8"?>', range(1, len(sheets) + 1)
    main = f"{_OFFICE}/spreadsheetml/2006/main"
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    tabs = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets, strict=True))
    links = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">{links}</Relationships>',
    }
    for i, rows in zip(n, sheets.values(), strict=True):
        body = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    return out.getvalue()


def write_sheet(rows: list[list[object]], name: str = "Sheet1") -> bytes:
    """A minimal workbook of one sheet; numbers stay numbers."""
    return write_workbook({name: rows})


PARSED, CONTENT = GRID + ", error string", "doc_id string, content binary"
#: What a damaged file raises: bad archives and XML, missing parts, cells out of place, delimiters out of bounds.
UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, TypeError, ValueError, IndexError, csv.Error, zlib.error, EOFError)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        out = []
        for path, content in zip(files["path"], files["content"], strict=True):
            rows, error = [], None
            try:
                rows = csv_rows(content) if path.lower().endswith(".csv") else sheet_rows(content)
            except UNREADABLE as e:
                error = f"{type(e).__name__}: {e}"
            out += [(path, 1, i, r, None) for i, r in enumerate(rows)] or [(path, 1, None, None, error)]
        frame = pd.DataFrame(out, columns=["doc_id", "page", "row", "cells", "error"])
        yield frame.astype({"row": "Int32"})


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, content) to rows and an error column; a file without rows has one row whose row and cells are null.
    Also for a stream of binaryFile."""
    return files.select("path", "content").mapInPandas(_parse, PARSED)


def grid_of(parsed: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """The grid of parsed files; pages: 0-based pages to keep."""
    grid = parsed.filter("row IS NOT NULL").drop("error")
    return grid if pages is None else grid.filter(F.col("page").isin([p + 1 for p in pages]))


def documents_of(parsed: DataFrame) -> DataFrame:
    """doc_id, path, filename and error (null for files that could be read) of every parsed file."""
    name = F.regexp_extract("doc_id", r"([^/]*)$", 1)
    return parsed.groupBy("doc_id").agg(F.max("error").alias("error")).select("doc_id", F.col("doc_id").alias("path"), name.alias("filename"), "error")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All .csv and .xlsx files under a path, parsed once into the shared folder: see grid_of() and documents_of()."""
    return keep(parse_files(spark.read.format("binaryFile").load(path)), "files")


def read_grids(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """The grids of all .csv and .xlsx files under a path; pages: 0-based pages to keep."""
    return grid_of(parse_files(spark.read.format("binaryFile").load(path)), pages)


def words_grid(ruled: DataFrame, words: DataFrame) -> DataFrame:
    """The grid of PDF pages from what any PDF reader delivers: ruled tables (doc_id, page, row, cells) and positioned words
    (doc_id, page, word_idx, text, x0, x1, top). A page's ruled table counts unless it is only a small table on a page
    full of words; all other pages are laid out from their words."""
    n_words = words.groupBy("doc_id", "page").agg(F.count("*").alias("n_words"))
    sizes = ruled.groupBy("doc_id", "page").agg(F.count("*").alias("n_rows")).join(n_words, ["doc_id", "page"], "left")
    good = sizes.filter(~layout.reject_small_table(F.coalesce("n_words", F.lit(0)), F.col("n_rows"))).select("doc_id", "page")
    laid = layout.grid_from_words(words.join(good, ["doc_id", "page"], "left_anti"))
    return ruled.join(good, ["doc_id", "page"], "left_semi").select("doc_id", "page", "row", "cells").unionByName(laid)


def _files(made: Callable[[list[list[str]]], bytes]):
    """Files of documents whose rows follow each other; only one document's rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []
        pack = lambda done: pa.record_batch([pa.array([d for d, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary())], names=["doc_id", "content"])
        for batch in batches:
            done = []
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and name != doc:
                    done.append((doc, made(held)))
                    held = []
                doc = name
                held.append(cells)
            if done:
                yield pack(done)
        if held:
            yield pack([(doc, made(held))])

    return run


def _by_document(grid: DataFrame, made: Callable[[list[list[str]]], bytes]) -> DataFrame:
    """doc_id and content of each document: whole documents stream through a task in order, without a frame for each.

    The number of tasks is given: rows are few bytes and much work, and Spark would join tasks by bytes.
    """
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.select(F.col("doc_id").cast("string").alias("doc_id"), "page", "row", "cells").repartition(tasks, "doc_id")
    return dealt.sortWithinPartitions("doc_id", F.asc_nulls_last("page"), F.asc_nulls_last("row")).select("doc_id", "cells").mapInArrow(_files(made), CONTENT)


def _delimited(rows: list[list[str]]) -> bytes:
    text = io.StringIO(newline="")
    csv.writer(text).writerows(rows)
    return text.getvalue().encode()


def delimited(grid: DataFrame) -> DataFrame:
    """doc_id and content (delimited lines) of each document; a document's rows are held together, as it is one file."""
    return _by_document(grid, _delimited)


_NUMBER = re.compile(r"-?\d+\.?\d*")


def _numbers(rows: list[list[str]]) -> list[list[object]]:
    """Below the first row, what looks like a number is one."""
    return rows[:1] + [[float(c) if c is not None and _NUMBER.fullmatch(c.strip()) else c for c in r] for r in rows[1:]]


def workbooks(grid: DataFrame) -> DataFrame:
    """doc_id and content (a workbook of one sheet) of each document; a document's rows are held together, as it is one file."""
    return _by_document(grid, lambda rows: write_sheet(_numbers(rows)))


def _report(table: pd.DataFrame) -> pd.DataFrame:
    table = table.sort_values(["sheet", "ord"], ascending=[False, True])  # the ledger's name sorts after the audit's
    sheets = {name: _numbers([list(r) for r in rows["cells"]]) for name, rows in table.groupby("sheet", sort=False)}
    return pd.DataFrame({"doc_id": table["doc_id"].iloc[:1], "content": [write_workbook(sheets)]})


def report_workbooks(rows: DataFrame) -> DataFrame:
    """doc_id and content (a workbook) of rows of sheets (doc_id, sheet, ord, cells), as operators.report makes them."""
    return rows.select("doc_id", "sheet", "ord", "cells").groupBy("doc_id").applyInPandas(_report, CONTENT)


def common_folder(documents: DataFrame) -> str:
    """The folder that all doc_ids share: what the least and the greatest of them begin with."""
    ends = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    return os.path.commonprefix([e or "" for e in ends]).rpartition("/")[0]


def file_names(documents: DataFrame, suffix: str, root: str | None = None) -> DataFrame:
    """doc_id and name of the file that each document is written to: its path below root (the folder that all share,
    unless one is given), with the suffix in place of its own; documents that would share a name keep their own suffix before it. A path outside root counts as a whole.

    Names that are still shared (a doc_id that occurs twice, say) are an error.
    """
    root = common_folder(documents) if root is None else root
    full, base = F.col("doc_id"), F.lit(root.rstrip("/") + "/")
    inner = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full))).otherwise(F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", ""))
    safe = F.regexp_replace(F.regexp_replace(inner, r"(^|/)\.{1,2}(?=/|$)", "$1_"), "^/+|/+$", "")
    path = F.when(safe == "", "document").otherwise(safe)
    short = F.regexp_replace(path, r"\.[^./]*$", "")
    named = documents.select("doc_id", path.alias("path"), F.when((short == "") | short.endswith("/"), path).otherwise(short).alias("short"))
    shared = named.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").select("short", F.lit(True).alias("shared"))
    out = keep(named.join(shared, "short", "left").select("doc_id", F.concat(F.when(F.col("shared"), F.col("path")).otherwise(F.col("short")), F.lit(suffix)).alias("name")), "names")
    twice = out.groupBy("name").count().filter("count > 1").orderBy("name").limit(3).collect()
    if twice:
        raise ValueError("several documents would be written to " + ", ".join(r["name"] for r in twice))
    return out


def write_documents(contents: DataFrame, folder: str, suffix: str, root: str | None = None) -> None:
    """A file for each row of (doc_id, content), named by file_names(), in a folder (a URI that pyarrow knows) that all
    tasks share.

    Tasks write under names of their own attempt, and what the successful attempts have written is noted in a table; only
    then a second job moves each file to its name. A retried, repeated or lost task leaves nothing half written, and
    moving again what has been moved does no harm.
    """
    away = f"_writing-{uuid.uuid4().hex}"
    rows = contents.select("doc_id", "content").join(file_names(contents, suffix, root), "doc_id").select("name", "content")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(folder)
        for files in batches:
            held = []
            for content in files["content"]:
                held.append(f"{away}/{uuid.uuid4().hex}")
                if not len(held) - 1:
                    store.create_dir(f"{base}/{away}", recursive=True)
                with store.open_output_stream(f"{base}/{held[-1]}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": files["name"], "held": held})

    def move(rows: Iterator) -> None:
        store, base = pafs.FileSystem.from_uri(folder)
        known: set[str] = set()
        for r in rows:
            target = f"{base}/{r['name']}"
            place = target.rsplit("/", 1)[0]
            if place not in known:
                store.create_dir(place, recursive=True)
                known.add(place)
            if store.get_file_info(f"{base}/{r['held']}").type != pafs.FileType.NotFound:  # else an attempt before has moved it
                store.move(f"{base}/{r['held']}", target)

    try:
        noted = keep(rows.mapInPandas(put, "name string, held string"), "written")
        noted.foreachPartition(move)
        discard(noted)
    finally:
        store, base = pafs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{base}/{away}").type == pafs.FileType.Directory:
            store.delete_dir(f"{base}/{away}")
