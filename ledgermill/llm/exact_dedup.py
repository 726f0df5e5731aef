"""Exact dedup against history: a sharded minimal perfect hash over distinct digests of documents seen before.

Two texts are equal when they are identical after each run of ASCII white space becomes one space. History (what an
earlier run has kept) is held as an index: each shard is a minimal perfect hash (hash and displace: a seed for each
bucket of keys, singletons placed directly) whose slots hold full 32-byte digests and the winner's doc_id. A lookup
computes one slot and compares all 32 bytes, so a wrong hit is impossible; repeats of history are removed, and digests
that are not members group among themselves.

Cases: null text counts as empty; empty texts are one group; ties (several rows of one text) keep the smallest doc_id;
a null doc_id comes after all others, and in a group that has no other keep_id is null and all rows are marked kept;
rows with the same doc_id and text count as a group of their own size; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M1, SPACE, fields, free_name, mix64, save
from .packed import rows_table

#: In winners where a group has no doc_id (named tells it from a real one): after all others.
LAST = (1 << 63) - 1
#: Keys for each seed of a shard's hash, and about how many keys a shard has.
BUCKET_KEYS, SHARD_KEYS = 4, 50_000
INDEX_SCHEMA = "shard int, n int, seeds binary, digests binary, winners binary, named binary, sizes binary"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long, in_history boolean"


def _digest() -> Column:
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, computed in the JVM."""
    return fields(docs, "doc_id", "text").select("doc_id", _digest().alias("digest"))


def _groups(d: DataFrame) -> DataFrame:
    """One row for each digest; Spark aggregates within tasks first, so a large group leaves each task as one row."""
    return d.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int"))


def _keys(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each digest."""
    parts = np.ascontiguousarray(blob[:, :16]).view("<u8")
    return parts[:, 0], parts[:, 1]


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h + seed.astype(np.uint64) * M1) % np.uint64(n)).astype(np.int64)


def build_hash(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and the slot of each of n distinct digests; slots are 0..n-1, each taken once. A seed below 0 names a slot."""
    n = len(blob)
    h1, h2 = _keys(blob)
    buckets = (h1 % np.uint64(n // BUCKET_KEYS + 1)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    sizes = np.bincount(buckets, minlength=n // BUCKET_KEYS + 1)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    seeds, slots, taken = np.zeros(len(sizes), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    tries = np.arange(64, dtype=np.int64)
    for b in by_size[: int((sizes > 1).sum())]:
        own = order[starts[b] : starts[b + 1]]
        base = 0
        while True:  # 64 seeds at a time; the first that puts all keys of the bucket on distinct free slots
            at = np.stack([_slot(np.full(64, h2[i]), base + tries, n) for i in own])
            free = ~taken[at].any(axis=0)
            for t in np.flatnonzero(free):
                if len(set(at[:, t].tolist())) == len(own):
                    seeds[b], slots[own] = base + t, at[:, t]
                    taken[at[:, t]] = True
                    break
            else:
                base += 64
                continue
            break
    single = by_size[int((sizes > 1).sum()) : int((sizes > 0).sum())]
    left = np.flatnonzero(~taken)
    own = order[starts[single]]
    slots[own], seeds[single] = left[: len(own)], -left[: len(own)] - 1
    return seeds, slots


def find(blob: np.ndarray, seeds: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where the slot's 32 bytes differ."""
    n = len(held)
    if not n or not len(blob):
        return np.full(len(blob), -1, np.int64)
    h1, h2 = _keys(blob)
    seed = seeds[(h1 % np.uint64(len(seeds))).astype(np.int64)]
    at = np.where(seed < 0, -seed - 1, _slot(h2, np.maximum(seed, 0), n))
    return np.where((held[at] == blob).all(axis=1), at, -1)


def _blob(column: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, 32)


def _winners(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, LAST for null, and which are not null."""
    return column.fill_null(LAST).to_numpy().astype("<i8"), column.is_valid().to_numpy()


def _build(table: pa.Table) -> pa.Table:
    blob = _blob(table["digest"])
    seeds, slots = build_hash(blob)
    held, winners, named, sizes = np.zeros_like(blob), np.zeros(len(blob), "<i8"), np.zeros(len(blob), bool), np.zeros(len(blob), "<i8")
    held[slots], sizes[slots] = blob, table["group_size"].to_numpy()
    winners[slots], named[slots] = _winners(table["keep_id"])
    row = {"shard": table["shard"][0].as_py(), "n": len(blob), "seeds": seeds.astype("<i8").tobytes(), "digests": held.tobytes(), "winners": winners.tobytes(), "named": named.tobytes(), "sizes": sizes.tobytes()}
    return rows_table(INDEX_SCHEMA, [row])


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over a (doc_id, digest) table: one row a shard, stored in the shared folder."""
    return save(_sharded(_groups(history), shards).groupBy("shard").applyInArrow(_build, INDEX_SCHEMA), "dedup-index")


def _resolve(index: pa.Table, asked: pa.Table) -> pa.Table:
    """All groups of a shard: history's with the repeats found by lookup, then those of digests that are not members."""
    if index.num_rows:
        seeds, held = np.frombuffer(index["seeds"][0].as_py(), "<i8"), np.frombuffer(index["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        winners, named, sizes = (np.frombuffer(index[c][0].as_py(), kind).copy() for c, kind in (("winners", "<i8"), ("named", bool), ("sizes", "<i8")))
    else:
        seeds, held, winners, named, sizes = np.zeros(1, np.int64), np.zeros((0, 32), np.uint8), np.zeros(0, "<i8"), np.zeros(0, bool), np.zeros(0, "<i8")
    blob = _blob(asked["digest"])
    (ids, known), counts = _winners(asked["keep_id"]), asked["group_size"].to_numpy()
    at = find(blob, seeds, held)
    hit, new = at >= 0, at < 0
    sizes[at[hit]] += counts[hit]
    np.minimum.at(winners, at[hit], ids[hit])
    named[at[hit]] |= known[hit]
    every = np.concatenate([held, blob[new]])
    return pa.table(
        {
            "digest": pa.array([x.tobytes() for x in every], pa.binary()),
            "keep_id": pa.array(np.concatenate([winners, ids[new]]), pa.int64(), mask=~np.concatenate([named, known[new]])),
            "group_size": pa.array(np.concatenate([sizes, counts[new]]), pa.int64()),
            "in_history": pa.array(np.concatenate([np.ones(len(held), bool), np.zeros(int(new.sum()), bool)])),
        }
    )


def resolve(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Groups of history and of a new (doc_id, digest) table. Both sides meet shard by shard; a shard's size is bounded."""
    asked = _sharded(_groups(incoming), shards)
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_resolve, GROUP_SCHEMA)


def dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs (and of history, if given).

    Without a history table, the lower half of the ids counts as seen before and the rest as the new batch. Where a
    group has rows in both, the smallest doc_id of both stays.
    """
    if history is None:
        d = save(digests(docs), "dedup-digests")
        middle, rows = d.agg(F.percentile_approx("doc_id", 0.5), F.count("*")).first()
        middle = -1 if middle is None else middle
        old, new = d.filter(F.col("doc_id") <= middle), d.filter((F.col("doc_id") > middle) | F.col("doc_id").isNull())
    else:
        old, new = save(digests(history), "dedup-digests"), save(digests(docs), "dedup-digests")
        d = old.unionByName(new)
        rows = d.count()
    shards = max(1, -(-rows // SHARD_KEYS))
    groups = save(resolve(build_index(old, shards), new, shards), "dedup-groups")
    # At most 1000 groups have over a thousandth of the rows: their rows meet a broadcast table, all others a shuffle.
    heavy = F.broadcast(groups.filter(F.col("group_size") > max(1000, rows // 1000)))
    light = groups.filter(F.col("group_size") <= max(1000, rows // 1000))
    joined = d.join(heavy, "digest").unionByName(d.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that dedup() keeps, with all their columns; of rows that repeat doc_id (or its lack) and text, one."""
    found = save(dedup(docs), "dedup-result")
    key = free_name(docs, "digest")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest")).distinct()
    left = docs.withColumn(key, _digest())
    on = left["doc_id"].eqNullSafe(gone["gone_id"]) & (left[key] == gone["gone_digest"])
    out = left.join(gone, on, "left_anti")
    if not found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", key])
    return out.drop(key)
