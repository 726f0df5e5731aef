"""Stored statements that can be changed: tables in buckets of statements, whole generations at a time.

Every table is dealt to buckets by a hash of its statement_id. A generation is a small manifest that names, for each table
and bucket, the folders that hold its rows; readers take the newest manifest and see nothing else. Adding statements adds
a folder to the buckets they fall in; correcting or deleting some rewrites the buckets of these statements alone, in all
tables, and only then the next manifest appears. So tables change together, a run that dies in between has changed nothing,
and of two writers that began from the same generation the second fails instead of undoing the first.

    store = Store.create(spark, "/data/ledgers", buckets=256)
    store.append(statement.process(...))
    store.correct(corrections)          # see operators.corrections
    store.delete(names)                 # statement_id
    store.read().transactions
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import keep
from ..operators.corrections import Stored, correct

TABLES = ("statements", "transactions", "repairs", "unparsed")
BUCKET = "_bucket"
#: Folders of one bucket beyond which an addition rewrites it.
MOST_FOLDERS = 16
#: Tasks, hence files, of one bucket in a folder.
PARTS = 4


class Conflict(RuntimeError):
    """Another writer has made the next generation."""


@dataclass(frozen=True)
class Manifest:
    """Which folders hold the rows of each table's buckets; a schema (DDL) for each table."""

    generation: int
    buckets: int
    folders: dict[str, dict[str, list[str]]]
    schemas: dict[str, str]

    def text(self) -> str:
        return json.dumps({"generation": self.generation, "buckets": self.buckets, "folders": self.folders, "schemas": self.schemas}, sort_keys=True)


class Store:
    """The stored tables under a folder; see the module."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 256) -> Store:
        """An empty store; one that is there already keeps its tables and its number of buckets."""
        store = cls(spark, root)
        if store._newest() is None:
            store._publish(Manifest(0, buckets, {t: {} for t in TABLES}, {}))
        return store

    # ------------------------------------------------------------ generations

    def _newest(self) -> int | None:
        folder = self._path(f"{self.root}/_generations")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)

    def manifest(self) -> Manifest:
        n = self._newest()
        if n is None:
            raise FileNotFoundError(f"no store at {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/_generations/{n:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return Manifest(**json.loads(bytes(text).decode()))

    def _publish(self, manifest: Manifest) -> None:
        """The manifest's file appears whole, under its number, or not at all."""
        target = self._path(f"{self.root}/_generations/{manifest.generation:012d}.json")
        held = self._path(f"{self.root}/_generations/.{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(held, False)
        try:
            out.write(bytearray(manifest.text().encode()))
        finally:
            out.close()
        if self._fs.exists(target) or not self._fs.rename(held, target):
            self._fs.delete(held, False)
            raise Conflict(f"generation {manifest.generation} is there already")

    # ------------------------------------------------------------ tables

    def _dealt(self, df: DataFrame, buckets: int) -> DataFrame:
        if BUCKET in df.columns:
            raise ValueError(f"a column may not be called {BUCKET}")
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col("statement_id").cast("string")), F.lit(buckets)).cast("int"))

    def _write(self, tables: dict[str, DataFrame], manifest: Manifest) -> str:
        """Writes rows of all tables into a folder of its own, up to PARTS parts a bucket: few buckets keep many tasks busy."""
        folder = f"{manifest.generation + 1:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            dealt = self._dealt(df, manifest.buckets)
            part = F.pmod(F.shiftright(F.xxhash64(F.col("statement_id").cast("string")), 32), F.lit(PARTS))  # other bits than the bucket's
            dealt.repartition(F.col(BUCKET), part).write.partitionBy(BUCKET).parquet(f"{self.root}/{name}/{folder}")
        return folder

    def _filled(self, name: str, folder: str) -> list[str]:
        """The buckets that a folder has rows of."""
        place = self._path(f"{self.root}/{name}/{folder}")
        return [n.split("=")[1] for n in (s.getPath().getName() for s in self._fs.listStatus(place)) if n.startswith(f"{BUCKET}=")]

    def _load(self, name: str, manifest: Manifest, only: set[str] | None = None) -> DataFrame:
        schema = manifest.schemas.get(name, "statement_id string")
        paths = [f"{self.root}/{name}/{f}/{BUCKET}={b}" for b, fs in manifest.folders[name].items() if only is None or b in only for f in fs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, only: set[str] | None = None, manifest: Manifest | None = None) -> Stored:
        """The tables of the newest generation; only: of these buckets."""
        m = manifest or self.manifest()
        return Stored(*(self._load(t, m, only) for t in TABLES))

    @staticmethod
    def _tables(stored) -> dict[str, DataFrame]:
        out = {t: getattr(stored, t) for t in TABLES}
        if "doc_id" in out["unparsed"].columns:
            out["unparsed"] = out["unparsed"].withColumnRenamed("doc_id", "statement_id")
        return out

    def _schemas(self, manifest: Manifest, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Columns that a table gains are null in the rows before; types stay."""
        out = dict(manifest.schemas)
        for name, df in tables.items():
            new = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields}
            old = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.createDataFrame([], out[name]).schema.fields} if name in out else {}
            if changed := [c for c in new if c in old and old[c] != new[c]]:
                raise ValueError(f"{name}: another type of {', '.join(changed)}")
            out[name] = ", ".join((old | new).values())
        return out

    # ------------------------------------------------------------ changes

    def append(self, processed) -> int:
        """Adds processed statements (Statements or Stored); returns the new generation."""
        m = self.manifest()
        tables = self._tables(processed)
        schemas, folder = self._schemas(m, tables), self._write(tables, m)
        folders = {t: dict(b) for t, b in m.folders.items()}
        for t in tables:
            for b in self._filled(t, folder):
                folders[t][b] = [*folders[t].get(b, []), folder]
        done = Manifest(m.generation + 1, m.buckets, folders, schemas)
        self._publish(done)
        full = {b for bs in folders.values() for b, fs in bs.items() if len(fs) > MOST_FOLDERS}
        return self._replace(self.spark.createDataFrame([], "statement_id string"), None, full).generation if full else done.generation

    def _buckets_of(self, names: DataFrame, buckets: int) -> set[str]:
        """At most as many as there are buckets."""
        return {str(r[0]) for r in self._dealt(names.select("statement_id"), buckets).select(BUCKET).distinct().collect()}

    def _replace(self, names: DataFrame, new: Stored | None, also: set[str] = frozenset(), since: Manifest | None = None) -> Manifest:
        """Rewrites the buckets of these statements: their rows go, new ones come."""
        m = since or self.manifest()
        touched = self._buckets_of(names, m.buckets) | set(also)
        old, gone = self._tables(self.read(touched, m)), names.select("statement_id").distinct()
        left = {t: df.join(gone, df["statement_id"].cast("string") == gone["statement_id"].cast("string"), "left_anti") for t, df in old.items()}
        tables = left if new is None else {t: left[t].unionByName(df, allowMissingColumns=True) for t, df in self._tables(new).items()}
        schemas, folder = self._schemas(m, tables), self._write(tables, m)
        folders = {t: {b: fs for b, fs in bs.items() if b not in touched} | {b: [folder] for b in self._filled(t, folder)} for t, bs in m.folders.items()}
        done = Manifest(m.generation + 1, m.buckets, folders, schemas)
        self._publish(done)
        return done

    def correct(self, corrections: DataFrame) -> int:
        """Applies corrections (statement_id, seq, key, value): the statements that they name are judged anew."""
        m = self.manifest()
        given = keep(corrections.select("statement_id", "seq", "key", "value"), "corrections")
        touched = self._buckets_of(given, m.buckets)
        names = given.select("statement_id").distinct()
        old = self.read(touched, m)
        mine = Stored(*(getattr(old, t).join(names, "statement_id", "left_semi") for t in TABLES))
        return self._replace(names, correct(mine, given), since=m).generation

    def delete(self, names: DataFrame) -> int:
        """Deletes statements with all that belongs to them."""
        return self._replace(names, None).generation

    def sweep(self) -> None:
        """Deletes what the newest generation does not name: what old generations held and what died half-way. Not while
        others read or write."""
        m = self.manifest()
        for t, buckets in m.folders.items():
            named = {(f, f"{BUCKET}={b}") for b, fs in buckets.items() for f in fs}
            place = self._path(f"{self.root}/{t}")
            for folder in self._fs.listStatus(place) if self._fs.exists(place) else []:
                own = {b for f, b in named if f == folder.getPath().getName()}
                if not own:
                    self._fs.delete(folder.getPath(), True)
                    continue
                for bucket in self._fs.listStatus(folder.getPath()):
                    if bucket.getPath().getName().startswith(f"{BUCKET}=") and bucket.getPath().getName() not in own:
                        self._fs.delete(bucket.getPath(), True)
