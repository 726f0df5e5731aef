"""Which of many names occur in which of many texts: a join on minimizers.

A (k, w)-minimizer of a text is the k-gram with the least hash among w neighbours. Every w neighbours of a name are also
neighbours in any text that contains the name, so the name's minimizers are among the text's: a name is found by any one
of them, and the one that fewest names have is taken. Short names have tiers of their own, down to single characters,
where every gram counts. Texts tell only keys that a bitmap of all names' keys lets through (16 MB whatever there is),
keys of very many texts are dealt to salts, and what shares a key is compared as a whole.

Cases: null and empty names and texts match nothing; repeated names are found each; rows of one id count as one text that
contains what any of them does; a null id is an id of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import discard, keep

#: Grams and neighbours of names from so many characters on (k + w - 1); shorter names are looked for as they are.
TIERS = [(12, 8), (5, 4)]
SHORT = 7
#: Bits of the bitmap of keys, and rows of one key that are joined in one task.
BITS, HEAVY = 27, 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tiers() -> list[tuple[int, int]]:
    return [*TIERS, *[(k, 1) for k in range(SHORT, 0, -1)]]


def tier_of(size: int) -> int:
    """The tier that finds names of so many characters."""
    return next(i for i, (k, w) in enumerate(tiers()) if size >= k + w - 1)


def gram_keys(chars: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the minimizers of texts that follow each other in an array of characters; ends: where texts end."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k * 64 + w))
        for i in range(k):
            h = (h ^ (h >> np.uint64(29))) * _M2 + (chars[i : i + n].astype(np.uint64) + np.uint64(1)) * _M1
        h = (h ^ (h >> np.uint64(32))) * _M2
        h ^= h >> np.uint64(29)
    inside = np.zeros(len(chars) + 1, np.int32)
    np.add.at(inside, np.maximum(ends - (k + w - 2), np.append(0, ends[:-1])), 1)
    np.add.at(inside, ends, -1)
    good = np.cumsum(inside)[: max(0, len(chars) - (k + w - 2))] == 0  # windows of one text
    if w == 1:
        at = np.flatnonzero(good)
        return at, h[at]
    windows = n - w + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = h[:windows].copy()
    for i in range(1, w):
        np.minimum(least, h[i : i + windows], out=least)
    chosen = np.zeros(n, bool)
    for i in range(w):
        chosen[i : i + windows] |= (h[i : i + windows] == least) & good[:windows]
    at = np.flatnonzero(chosen)
    return at, h[at]


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each ends."""
    raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at[1:] - at[0]


def _portions(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) // most).tolist()
    start = 0
    for i in range(1, len(part) + 1):
        if i == len(part) or part[i] != part[start]:
            yield start, i
            start = i


def _keys(used: list[int], bitmap=None):
    """(row of a batch's first column, key) of each text; used: the tiers, or those of each text's own size if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _portions(batch.column(1)):
                part = batch.slice(a, b - a)
                chars, ends = _characters(part.column(1))
                sizes = np.diff(np.append(0, ends))
                own = np.array([tier_of(s) if s else -1 for s in sizes.tolist()]) if not used else None
                rows, keys = [], []
                for t in used or sorted(set(own.tolist()) - {-1}):
                    at, h = gram_keys(chars, ends, *tiers()[t])
                    row = np.searchsorted(ends, at, "right")
                    if own is not None:
                        mine = own[row] == t
                        row, h = row[mine], h[mine]
                    if bitmap is not None:
                        place = (h >> np.uint64(64 - BITS)).astype(np.int64)
                        known = bitmap.value[place >> 6] >> (place & 63) & 1 == 1
                        row, h = row[known], h[known]
                    rows.append(row)
                    keys.append(h)
                if rows:
                    row, key = np.concatenate(rows), np.concatenate(keys)
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
                    yield pa.record_batch([part.column(0).take(pa.array(row[new])), pa.array(key[new].view(np.int64))], names=[part.schema.names[0], "key"])

    return run


def _bitmap(keys: DataFrame):
    """The broadcast bitmap of a table's keys: 2**BITS bits, whatever their number."""
    place = F.shiftrightunsigned("key", 64 - BITS)
    words = keys.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name_id) of each name that occurs in a text; texts: id, text; names: name_id, name."""
    kind, named = (df.schema[c].dataType.simpleString() for df, c in ((texts, "id"), (names, "name_id")))
    names = names.filter(F.coalesce("name", F.lit("")) != "").select("name_id", "name")
    own = keep(names.mapInArrow(_keys([]), f"name_id {named}, key bigint"), "name-keys")
    used = sorted(tier_of(r[0]) for r in names.select(F.least(F.octet_length("name"), F.lit(TIERS[0][0] + TIERS[0][1] - 1))).distinct().collect())  # lengths up to the longest tier's
    rare = own.join(own.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("name_id").agg(F.min(F.struct("n", "key")).alias("k"))
    chosen = keep(rare.select("name_id", F.col("k.key").alias("key")).join(names, "name_id"), "names-by-key")
    told = keep(texts.select("id", "text").mapInArrow(_keys(sorted(set(used)) or [0], _bitmap(chosen.select("key"))), f"id {kind}, key bigint"), "text-keys")
    total = told.count()
    limit = max(HEAVY, total // 1000)
    # at most 1000 keys have over a thousandth of the rows
    heavy = told.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > limit).select("key", F.ceil(F.col("rows") / limit).cast("int").alias("salts"))
    heavy = F.broadcast(keep(heavy, "heavy-keys"))
    salts = F.coalesce("salts", F.lit(1))
    left = told.join(heavy, "key", "left").select("id", "key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    right = chosen.join(heavy, "key", "left").select("name_id", "name", "key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = left.join(right, ["key", "salt"]).groupBy("id").agg(F.collect_list(F.struct("name_id", "name")).alias("found")).withColumnRenamed("id", "of")
    out = texts.select("id", "text").join(met, F.col("id").eqNullSafe(F.col("of"))).select("id", F.explode(F.filter("found", lambda f: F.contains(F.col("text"), f["name"]))).alias("f"))
    out = keep(out.select("id", "f.name_id").distinct(), "occurrences")
    discard(own, chosen, told)
    return out
