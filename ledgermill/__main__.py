"""python -m ledgermill scrub IN OUT [--randomize-amounts] | process IN OUT: files or folders of .csv and .xlsx.

scrub writes a masked file for each document into the folder OUT; process writes the statement tables and a report
workbook for each statement. Exit code 1 where IN can't be read or an argument is missing.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .operators import report, scrub
from .plans import statement
from .sources import grids


def _uri(path: str) -> str:
    import os

    return path if "://" in path else "file://" + os.path.abspath(path)


def _root(source: str) -> str:
    """The folder that documents' names are relative to, as Spark writes the paths of its files."""
    path = _uri(source).rstrip("/")
    folder = path.rsplit("/", 1)[0] if path.lower().endswith((".csv", ".xlsx")) else path
    return "file:" + folder.removeprefix("file://") if folder.startswith("file://") else folder


def scrub_files(spark: SparkSession, source: str, target: str, randomize_amounts: bool = False) -> None:
    """A masked copy of every file, in its own format."""
    parsed = grids.read_files(spark, _uri(source))
    masked = scrub.scrub_grid(grids.grid_of(parsed), randomize_amounts=randomize_amounts)
    is_csv = masked["doc_id"].rlike(r"(?i)\.csv$")
    grids.write_documents(grids.delimited(masked.filter(is_csv)), _uri(target), ".csv", _root(source))
    grids.write_documents(grids.workbooks(masked.filter(~is_csv)), _uri(target), ".xlsx", _root(source))


def process_files(spark: SparkSession, source: str, target: str) -> None:
    """Statement tables as Parquet, and report workbooks."""
    parsed = grids.read_files(spark, _uri(source))
    s = statement.process(grids.grid_of(parsed), documents=grids.documents_of(parsed))
    for name in ("statements", "transactions", "repairs", "unparsed"):
        getattr(s, name).write.mode("overwrite").parquet(f"{_uri(target)}/{name}")
    rows = report.report(s.statements, s.transactions, s.repairs, s.unparsed.withColumnRenamed("doc_id", "statement_id"))
    grids.write_documents(grids.report_workbooks(rows), f"{_uri(target)}/reports", ".xlsx", _root(source))
    s.discard()


def main(args: list[str]) -> int:
    options, names = [a for a in args if a.startswith("--")], [a for a in args if not a.startswith("--")]
    if len(names) != 3 or names[0] not in ("scrub", "process") or set(options) - {"--randomize-amounts"}:
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    try:
        if names[0] == "scrub":
            scrub_files(spark, names[1], names[2], "--randomize-amounts" in options)
        else:
            process_files(spark, names[1], names[2])
    except AnalysisException as e:  # no such path
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
