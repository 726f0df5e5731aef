"""Resampling towards a target distribution with a dictionary of distinct features.

A feature is a run of consecutive words; it falls into the bucket of its hash. A bucket's gain is the logarithm of the
ratio of its smoothed share in the target to that in the source; a document's weight is the mean gain of its features,
and the documents with the greatest weight plus Gumbel noise are drawn (without replacement, in proportion to the
exponentials of their weights).

Texts are read once, in portions of bounded bytes. A portion's distinct features are numbered, documents keep numbers
and counts. The dictionary of all portions' features is counted globally by string, each distinct string is hashed
once, and buckets are sums over the dictionary; their gains (one row a bucket, as many as the parameter says) are the
only broadcast. Gains come back to portions by a join on the feature, a row for each distinct feature of a portion, so
the most frequent word has one row a portion. Ranks follow from a range partitioning: places within partitions plus the
sizes of those before.

Cases: null texts count as empty; texts without words have no features, weight 0, and take no part in the draw when
least_words is over 0; a null doc_id has the noise of an empty id and comes last among ties; rows of one doc_id are rows
of their own; ties that remain (repeated rows) are ordered arbitrarily; an empty table gives no rows, an empty target
counts as 0 everywhere; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fields, save
from .encoding import portions
from .packed import narrow, wide
from .tokens import byte_table, coded_tokens, runs

#: Bytes of a portion's texts (or one text).
PORTION = 6_000_000
#: What no word holds: all of ASCII but letters and digits.
APART = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
COUNTED = "portion long, place int, feature string, n long, doc_id long, n_words long, n_features long, n_distinct int, places binary, counts binary"
_NAMES = [c.split()[0] for c in COUNTED.split(", ")]
_TYPES = dict(zip(_NAMES, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True))


def _batch(size_: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns[c].cast(_TYPES[c]) if c in columns else pa.nulls(size_, _TYPES[c]) for c in _NAMES], names=_NAMES)


def count_features(ids: pa.Array, texts: pa.Array, least: int, most: int, portion: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A portion's distinct features with their counts; where whole, also each document's features and how often it has them."""
    codes, words, bounds, _ = coded_tokens(texts, APART)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at, feature, names = runs(codes, words, doc, least, most)
    total = np.bincount(feature, minlength=len(names))
    yield _batch(len(names), portion=pa.array(np.full(len(names), portion)), place=pa.array(np.arange(len(names), dtype=np.int32)), feature=names.cast(pa.large_string()), n=pa.array(total))
    if not whole:
        return
    own, n = np.unique(doc[at] * max(1, len(names)) + feature, return_counts=True)
    cuts = np.searchsorted(own, np.arange(len(texts) + 1) * max(1, len(names)))
    own %= max(1, len(names))
    parts = [(narrow(own[a:b]), narrow(n[a:b]), int(n[a:b].sum())) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    yield _batch(
        len(texts), portion=pa.array(np.full(len(texts), portion)), doc_id=ids, n_words=pa.array(np.diff(bounds)), n_features=pa.array([p[2] for p in parts], pa.int64()),
        n_distinct=pa.array(np.diff(cuts)), places=pa.array([p[0] for p in parts], pa.binary()), counts=pa.array([p[1] for p in parts], pa.binary()),
    )


def counted(docs: DataFrame, least: int, most: int, whole: bool) -> DataFrame:
    """The table of count_features() over all texts; portions are numbered by the task that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in portions(batch.column(1), PORTION):
                part = batch.slice(a, b - a)
                yield from count_features(part.column(0), part.column(1), least, most, portion, whole)
                portion += 1

    ids = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("long"))
    return fields(ids, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, COUNTED)


def gains(dictionary: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain (thousandths of a logarithm, rounded down) of the buckets that a dictionary (bucket, s, t) has."""
    sums = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    all_s, all_t = F.sum("s").over(Window.partitionBy()), F.sum("t").over(Window.partitionBy())  # as many rows as there are buckets
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    return sums.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def _weigh(rows: pa.Table, told: pa.Table) -> pa.Table:
    gain = np.zeros(told.num_rows, np.int64)
    gain[told["place"].to_numpy()] = told["gain"].to_numpy()
    weights = []
    for own, n, length, size in zip(*(rows[c].to_pylist() for c in ("places", "counts", "n_distinct", "n_features")), strict=True):
        weights.append(int((gain[wide(own, length)] * wide(n, length)).sum()) // size if size else 0)
    return pa.table({"doc_id": rows["doc_id"], "n_words": rows["n_words"], "n_features": rows["n_features"], "weight": pa.array(weights, pa.int64())})


def weighted(docs: DataFrame, target: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    table = save(counted(docs, least, most, True), "resample-counts")
    wanted = counted(target, least, most, False).groupBy("feature").agg(F.sum("n").alias("t")).select("feature", F.lit(0).cast("long").alias("s"), "t")
    own = table.filter("place IS NOT NULL").select("portion", "place", "feature", "n")
    every = own.select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(wanted)
    dictionary = every.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(buckets)).cast("int"))
    dictionary = save(dictionary, "resample-dictionary")
    gain = save(gains(dictionary, buckets), "resample-gains")
    priced = dictionary.filter("s > 0").join(F.broadcast(gain), "bucket").select("feature", "gain")
    told = own.select("portion", "place", "feature").join(priced, "feature").select(F.col("portion").alias("told_to"), "place", F.col("gain").cast("long").alias("gain"))
    rows = table.filter("place IS NULL").select("portion", "doc_id", "n_words", "n_features", "n_distinct", "places", "counts")
    out = rows.groupBy("portion").cogroup(told.groupBy("told_to")).applyInArrow(_weigh, "doc_id long, n_words long, n_features long, weight long")
    out = save(out, "resample-weights")
    discard(table, dictionary, gain)
    return out


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """rows with rank (1, 2, 3, ...) in an order, as a saved table: partitions by ranges of the order, places within them."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id())
    placed = save(placed, "resample-order")
    part = F.shiftright("place__", 33)
    sizes = placed.groupBy(part.alias("part__")).agg(F.count("*").alias("size__"))
    before = F.coalesce(F.sum("size__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = F.broadcast(sizes.select("part__", before.alias("before__")))
    out = placed.withColumn("part__", part).join(starts, "part__")
    return out.withColumn("rank", F.col("before__") + F.col("place__").bitwiseAND((1 << 33) - 1) + 1).drop("part__", "place__", "before__")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for those that are not drawn.

    Of the rows with at least least_words words, the given percentage (rounded down) with the highest scores is drawn.
    """
    rows = weighted(docs, target, least, most, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = rows.withColumn("score", F.col("weight") + noise)
    taking_part = F.col("n_words") >= least_words
    placed = ranked(scored.filter(taking_part), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = placed.count() * percent // 100
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~taking_part).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents as (doc_id, rank), for a join by whoever needs their other columns."""
    return resample(docs, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")
