"""Collocations of each language by hashed candidate pruning (PCY and DHP), exact counts and their weakest cut.

Pass k counts the phrases of k words exactly and, on the side, drops every phrase of k + 1 words that can still be frequent
into one of many counted buckets. Buckets that reach the support become a bitmap; the frequent phrases of k words become
another. Pass k + 1 counts a phrase only if its bucket's bit is set and both phrases of k words in it have theirs
(Apriori). Bitmaps have no false negatives, and what they let through is counted by its string, so the result is exact
whatever the number of buckets. A bitmap has a bit for about 16 bytes of text, 2**27 bits (16 MB) at most: that is all
that is ever broadcast. Beyond some 2 GB of text buckets get fuller and prune less; the bitmaps of frequent phrases
are as sharp as their number allows.

Tasks add up buckets in arrays and phrases by portions of text, so a frequent phrase leaves a portion as one row; Spark
adds up the rest by (lang, phrase) or by ranges of buckets. The first n of a language are taken from the first n of each
of many salts.

Cases: null texts count as empty; a null lang is `und`, together with a lang of that name; pieces and texts without words
add nothing; repeated rows count each time; ties of score and count are ordered by the phrase's UTF-8 bytes, ties of cuts
go to the shorter first part; an empty table gives no rows; columns other than lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, discard, fields, mix64, save, text_bytes
from .encoding import portions
from .packed import narrow, pack_keys, rows_table, unpack_keys, wide
from .tokens import byte_table, coded_tokens, runs

#: Bytes of a portion's texts; least and most bits of a bucket's number; buckets of one range, as a power of two.
PORTION, LEAST_BITS, MOST_BITS, RANGE_BITS = 4_000_000, 16, 27, 20
#: Salts of a language's candidates when the first of them are taken.
SALTS = 64
PIECES = byte_table(b" \t", b".,;:!?\n\v\f\r")
COUNTED = "lang string, phrase string, n long, part int, first long, size long, keys binary, counts binary"
_NAMES = [c.split()[0] for c in COUNTED.split(", ")]
_TYPES = dict(zip(_NAMES, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))


def _batch(size_: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns[c].cast(_TYPES[c]) if c in columns else pa.nulls(size_, _TYPES[c]) for c in _NAMES], names=_NAMES)


def _hashes(names: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in names.cast(pa.large_binary()).to_pylist()], np.uint64)


def gram_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their languages and, one array a place, their words."""
    with np.errstate(over="ignore"):
        h = mix64(langs + np.uint64(len(words)))
        for w in words:
            h = mix64((h + w) * M1)
    return h


class Bitmap:
    """One bit for each value of a hash's first bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _add(held: np.ndarray, h: np.ndarray, most: int) -> None:
    """Counts phrases into their buckets; from the support on, a bucket is full."""
    at, n = np.unique(h >> np.uint64(64 - (len(held).bit_length() - 1)), return_counts=True)
    at = at.astype(np.int64)
    held[at] = np.minimum(held[at] + n, most)


def _full(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counted buckets of a task, packed by ranges."""
    for part in range(-(-len(held) >> RANGE_BITS)):
        mine = held[part << RANGE_BITS : (part + 1) << RANGE_BITS]
        at = np.flatnonzero(mine)
        if len(at):
            one = lambda x, kind: pa.array([x], kind)
            yield _batch(1, part=one(part, pa.int32()), first=one(int(at[0]), pa.int64()), size=one(len(at), pa.int64()), keys=one(pack_keys(at.astype(np.uint64)), pa.binary()), counts=one(narrow(mine[at]), pa.binary()))


def _pass(width: int, support: int, bits: int, last: bool, shared: list):
    """Counts phrases of `width` words that the bitmaps allow, and buckets of those that are one word longer; shared: the
    broadcast bitmaps (frequent phrases, buckets) of each pass before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint16 if support < 60_000 else np.int64)
        for batch in batches:
            for a, b in portions(batch.column(1), PORTION):
                yield from portion(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), held)
        if not last:
            yield from _full(held)

    def portion(langs: pa.Array, texts: pa.Array, held: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, words, bounds, piece = coded_tokens(texts, PIECES)
        if not len(codes):
            return
        coded = langs.dictionary_encode()
        lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
        h, lang_h = _hashes(words)[codes], _hashes(coded.dictionary)[lang]
        hashed = lambda at, k: gram_hashes(lang_h[at], [h[at + i] for i in range(k)])
        at = np.arange(len(codes))
        for k in range(2, width + 2):  # the starts of phrases of k words that can be frequent
            before = at
            ok = at + k - 1 < len(codes)
            at = at[ok]
            at = at[piece[at] == piece[at + k - 1]]
            if k <= width:
                frequent, buckets = shared[k - 2].value
                known = np.zeros(len(codes), bool)
                known[before[frequent.has(hashed(before, k - 1))]] = True
                at = at[known[at] & known[at + 1]]
                at = at[buckets.has(hashed(at, k))]
            elif not last:
                if width > 1:
                    known = np.zeros(len(codes), bool)
                    known[before] = True
                    at = at[known[at] & known[at + 1]]
                _add(held, hashed(at, k), support)
        counted = before
        if len(counted):
            # the phrases' words as an array of their own: one piece each
            flat = (counted[:, None] + np.arange(width)).ravel()
            starts, code, names = runs(codes[flat], words, np.repeat(np.arange(len(counted)), width), width, width)
            pairs, n = np.unique(lang[counted[starts // width]] * len(names) + code, return_counts=True)
            phrase = names.take(pa.array(pairs % len(names))).cast(pa.large_string())
            yield _batch(len(pairs), lang=coded.dictionary.take(pa.array(pairs // len(names))), phrase=phrase, n=pa.array(n))

    return run


def _marks(width: int, bits: int):
    """The bits of a table of phrases (lang, phrase), packed as _full() does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(0).dictionary_encode()
                words = pc.split_pattern(batch.column(1).cast(pa.large_binary()), b" ").flatten().dictionary_encode()
                h = _hashes(words.dictionary)[words.indices.to_numpy()].reshape(-1, width)
                lang = _hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
                held[(gram_hashes(lang, list(h.T)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
        yield from _full(held)

    return run


def _range_bits(support: int):
    """The bits of one range: buckets whose counts, over all tasks, reach the support."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << RANGE_BITS, np.int64)
        for r in table.select(["first", "size", "keys", "counts"]).to_pylist():
            sums[unpack_keys(r["first"], r["keys"], r["size"]).astype(np.int64)] += wide(r["counts"], r["size"])
        return rows_table("part int, bits binary", [{"part": table["part"][0].as_py(), "bits": np.packbits(sums >= support, bitorder="little").tobytes()}])

    return run


def _bitmap(ranges: DataFrame, support: int, bits: int) -> Bitmap:
    """The bitmap of packed ranges; at most 2**MOST_BITS bits come to the driver."""
    words = np.zeros(max(1 << bits, 1 << RANGE_BITS) >> 3, np.uint8)
    for r in ranges.select("part", "first", "size", "keys", "counts").groupBy("part").applyInArrow(_range_bits(support), "part int, bits binary").toLocalIterator():
        words[r["part"] << RANGE_BITS - 3 : (r["part"] + 1) << RANGE_BITS - 3] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(words, bits)


def frequencies(docs: DataFrame, most: int, support: int, bits: int | None = None) -> list[DataFrame]:
    """(lang, phrase, n) of all words, then of the phrases of 2, 3, ... `most` words that occur `support` times or more."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (text_bytes(docs) // 16).bit_length()))
    rows = fields(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    out, shared, sc = [], [], docs.sparkSession.sparkContext
    for width in range(1, most + 1):
        table = save(rows.mapInArrow(_pass(width, support, bits, width == most, shared), COUNTED), "collocation-counts")
        counts = table.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        out.append(save(counts if width == 1 else counts.filter(F.col("n") >= support), "collocation-phrases"))
        if width < most:
            frequent = out[-1].filter(F.col("n") >= support).select("lang", "phrase").mapInArrow(_marks(width, bits), COUNTED)
            shared.append(sc.broadcast((_bitmap(frequent, 1, bits), _bitmap(table.filter("part IS NOT NULL"), support, bits))))
        discard(table)
    return out


def candidates(known: list[DataFrame], support: int) -> DataFrame:
    """lang, phrase, a, l, r and score of the frequent phrases of two words or more, at their lowest-scoring cut."""
    parts = known[0].filter(F.col("n") >= support)
    for longer in known[1:-1]:
        parts = parts.unionByName(longer)
    phrases = known[1]
    for longer in known[2:]:
        phrases = phrases.unionByName(longer)
    words = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = words.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    # decimals of 38 digits: exact up to counts of 10**16
    exact = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    cut = cut.withColumn("score", F.expr(f"CAST(1000000 * {exact('a')} * {exact('a')} AS DECIMAL(38,0)) DIV CAST({exact('l')} * {exact('r')} AS DECIMAL(38,0))"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def contained(known: list[DataFrame]) -> DataFrame:
    """lang, phrase and longer: the greatest count of a frequent longer phrase that contains the phrase."""
    found = None
    for width, table in enumerate(known[2:], 3):
        spans = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for k in range(2, width) for i in range(1, width - k + 2)]
        inner = table.select("lang", F.split("phrase", " ").alias("w"), "n", F.explode(F.array(*spans)).alias("s"))
        inner = inner.select("lang", F.array_join(F.slice("w", F.col("s.i"), F.col("s.k")), " ").alias("phrase"), "n")
        found = inner if found is None else found.unionByName(inner)
    return found.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine(docs: DataFrame, most: int = 3, support: int = 10, percent: int = 50, first: int = 2000, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first collocations of 2 to `most` (2 at least) words.

    a, l, r count the phrase and the two parts of its lowest-scoring cut; score is 1000000 * a * a / (l * r), rounded down;
    n counts all words of the language. A phrase inside a longer frequent one that has at least `percent` hundredths of its
    occurrences is left out.
    """
    known = frequencies(docs, most, support, bits)
    found = candidates(known, support)
    if most > 2:
        found = found.join(contained(known), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    totals = known[0].groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
