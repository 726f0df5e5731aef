"""File-drop ingestion: statements that arrive in a folder are processed and stored, each file once.

Statements are self-contained, so the query keeps no state and needs no watermark; the checkpoint remembers files. Each
table has a folder for each batch, which a repeated batch overwrites: a failure between two tables duplicates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..lineage import discard, keep
from ..plans import statement
from ..sources import grids

TABLES = ("statements", "transactions", "repairs", "unparsed")


def ingest(files: DataFrame, target: str, batch: int, **options) -> None:
    """Processes files (path, content) and stores their tables under target, in the batch's own folders."""
    parsed = keep(grids.parse_files(files), "files")
    done = statement.process(grids.grid_of(parsed), documents=grids.documents_of(parsed), **options)
    for name in TABLES:
        getattr(done, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={batch}")
    done.discard()
    discard(parsed)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Processes what lies in source and ends (run it again for what comes later)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(source)
    return files.writeStream.foreachBatch(lambda batch, number: ingest(batch, target, number, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
