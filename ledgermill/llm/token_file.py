"""A compressed binary file of token ids: static range asymmetric numeral system in independent interleaved blocks.

The file is a table of shards. Documents are sorted by ranges of doc_id (Spark's own range partitioning), a part of the
file for each range; a part's writer streams through its rows and closes a shard whenever it has SHARD_IDS ids, so parts
and shards are in ascending doc_id order, and nothing but one shard is ever in memory. A shard's row holds part and
shard (its number in the part), n_ids, and

  table      the shard's frequencies, shared by all its blocks: zlib of u32[vocabulary], summing to 2**SCALE
  doc_ids    i64[], ascending (a null doc_id is the least i64)     lengths  u32[], ids of each document
  offsets    u32[], checkpoint of each block: where its words begin (one more entry: the end)
  states     u64[blocks, LANES], the decoder's first states        crcs     u32[], CRC-32 of each block's u32 ids
  words      u32[], the coded words of all blocks

A block is BLOCK ids; position p of it belongs to lane p mod LANES. A lane's 64-bit state lies in [2**31, 2**63), and
takes a 32-bit word at most once an id, in the order of positions; so any block decodes alone from its checkpoint, and
the lanes of many blocks decode side by side in one vector. The last block is filled up with the commonest id.

Cases: null and empty texts are documents of the end id alone; rows with the same doc_id, or without one, each have an
entry (in the order of a hash of their texts); an empty table makes an empty file; columns other than doc_id and text are ignored. A block whose
checksum fails raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, pieces, save, text_bytes, tidy
from .encoding import Encoder, portions, vocabulary_size
from .packed import rows_table

#: Bits of the frequencies, ids of a block, its lanes, ids after which a shard closes, and MB of a range's texts.
SCALE, BLOCK, LANES, SHARD_IDS, RANGE_MB = 18, 65_536, 32, 2_000_000, 32.0
LOW = np.uint64(1 << 31)
NONE = -(1 << 63)
SCHEMA = "part int, shard int, n_ids long, vocabulary int, table binary, doc_ids binary, lengths binary, offsets binary, states binary, crcs binary, words binary"


def frequencies(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE, at least 1 for each id that occurs."""
    counts = np.bincount(ids, minlength=vocabulary).astype(np.int64)
    total, whole = int(counts.sum()), 1 << SCALE
    out = np.where(counts > 0, np.maximum(1, counts * whole // max(total, 1)), 0)
    spare = whole - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if spare >= 0:
        out[order[0]] += spare
    for i in order:  # what the minimum of 1 took too much comes off the commonest ids
        if spare >= 0:
            break
        take = min(-spare, int(out[i] // 2))
        out[i] -= take
        spare += take
    return out.astype(np.uint32)


def encode_ids(ids: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, states, checksums and words of the blocks of a u32 array."""
    blocks = max(1, -(-len(ids) // BLOCK)) if len(ids) else 0
    size = BLOCK if len(ids) >= BLOCK else -(-max(len(ids), 1) // LANES) * LANES
    crcs = np.array([zlib.crc32(ids[i * size : (i + 1) * size].tobytes()) for i in range(blocks)], "<u4")
    filled = np.full(blocks * size, freq.argmax(), np.int64)
    filled[: len(ids)] = ids
    steps = size // LANES
    grid = filled.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    f64 = freq.astype(np.uint64)
    cum = np.cumsum(f64) - f64
    limit = f64 << np.uint64(63 - SCALE)
    state = np.full(blocks * LANES, LOW)
    words, taken = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
    shift, scale = np.uint64(32), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        f = f64[s]
        over = state >= limit[s]
        words[t], taken[t] = state.astype(np.uint32), over
        state = np.where(over, state >> shift, state)
        q = state // f
        state = (q << scale) + (state - q * f) + cum[s]
    taken = taken.reshape(steps, blocks, LANES).transpose(1, 0, 2)
    offsets = np.concatenate([[0], np.cumsum(taken.sum(axis=(1, 2)))]).astype("<u4")
    return offsets, state.reshape(blocks, LANES), crcs, words.reshape(steps, blocks, LANES).transpose(1, 0, 2)[taken]


def decode_blocks(freq: np.ndarray, offsets: np.ndarray, states: np.ndarray, words: np.ndarray, n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first..last-1 (all by default); only their words are read."""
    every = len(states)
    last = every if last is None else last
    size = BLOCK if n_ids >= BLOCK else -(-max(n_ids, 1) // LANES) * LANES
    blocks, steps = last - first, size // LANES
    f64 = freq.astype(np.uint64)
    cum = np.cumsum(f64) - f64
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)  # of each slot
    state, at = states[first:last].copy(), offsets[first:last].astype(np.int64)[:, None]
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    out = np.empty((steps, blocks, LANES), np.uint32)
    mask, shift, scale = np.uint64((1 << SCALE) - 1), np.uint64(32), np.uint64(SCALE)
    for t in range(steps):
        slot = state & mask
        s = symbol[slot.astype(np.int64)]
        out[t] = s
        state = f64[s] * (state >> scale) + slot - cum[s]
        low = state < LOW
        rank = np.cumsum(low, axis=1)
        state = np.where(low, (state << shift) | words[np.where(low, at + rank - 1, -1)], state)
        at = at + rank[:, -1:]
    ids = out.transpose(1, 0, 2).reshape(-1)
    return ids[: max(0, min(n_ids, last * size) - first * size)]


def _shard(part: int, shard: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], vocabulary: int) -> pa.RecordBatch:
    """The row of a shard of (doc_ids, lengths, ids) that follow each other."""
    doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
    ids = ids.astype("<u4")
    freq = frequencies(ids, vocabulary)
    offsets, states, crcs, words = encode_ids(ids, freq)
    row = {
        "part": part, "shard": shard, "n_ids": len(ids), "vocabulary": vocabulary, "table": zlib.compress(freq.astype("<u4").tobytes(), 6),
        "doc_ids": doc_ids.astype("<i8").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
        "offsets": offsets.tobytes(), "states": states.astype("<u8").tobytes(), "crcs": crcs.tobytes(), "words": words.astype("<u4").tobytes(),
    }
    return rows_table(SCHEMA, [row]).to_batches()[0]


def _write(path: str, end_id: int, vocabulary: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = Encoder.of(path), TaskContext.get().partitionId(), 0
        held, n = [], 0
        for batch in batches:
            for a, b in portions(batch.column(1), 12_000_000):
                rows = batch.slice(a, b - a)
                ids, offsets = coder.encode(rows.column(1))
                keys, lengths = rows.column(0).fill_null(NONE).to_numpy(zero_copy_only=False), np.diff(offsets) + 1
                ids = np.insert(ids, offsets[1:], end_id)  # behind each document
                while n + len(ids) >= shard_ids:  # the document that fills a shard is its last
                    ends = np.cumsum(lengths)
                    k = int(np.searchsorted(ends, shard_ids - n)) + 1
                    yield _shard(part, shard, [*held, (keys[:k], lengths[:k], ids[: ends[k - 1]])], vocabulary)
                    keys, lengths, ids = keys[k:], lengths[k:], ids[ends[k - 1] :]
                    held, n, shard = [], 0, shard + 1
                if len(keys):
                    held.append((keys, lengths, ids))
                    n += len(ids)
        if held:
            yield _shard(part, shard, held, vocabulary)
        tidy()

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS, range_mb: float = RANGE_MB) -> DataFrame:
    """Encodes all documents into the file (a table in the shared folder); one shuffle deals the texts to doc_id ranges."""
    size = vocabulary_size(tokenizer)
    rows = fields(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(pieces(text_bytes(docs), range_mb), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return save(dealt.mapInArrow(_write(tokenizer, end_id, max(size, end_id + 1), shard_ids), SCHEMA), "token-file")


def decode_shard(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of one shard; every block's checksum is compared."""
    freq = np.frombuffer(zlib.decompress(row["table"]), "<u4")
    offsets, crcs = np.frombuffer(row["offsets"], "<u4"), np.frombuffer(row["crcs"], "<u4")
    states = np.frombuffer(row["states"], "<u8").reshape(-1, LANES)
    ids = decode_blocks(freq, offsets, states, np.frombuffer(row["words"], "<u4"), row["n_ids"])
    size = max(1, -(-len(ids) // max(1, len(crcs)))) if len(ids) < BLOCK else BLOCK
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * size : (i + 1) * size].tobytes()) != crc:
            raise ValueError(f"part {row['part']}, shard {row['shard']}, block {i}: checksum")
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<u4"), ids


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                doc_ids, lengths, ids = decode_shard(row)
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                raw = ids.astype("<u4").tobytes()
                cuts = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(begins), row["part"], np.int32)), pa.array(np.full(len(begins), row["shard"], np.int32)),
                    pa.array(doc_ids, pa.int64(), mask=doc_ids == NONE), pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in cuts], pa.int64()),
                ]
                yield pa.record_batch(columns + [pa.array(cuts, pa.binary())] * with_ids, names=["part", "shard", "doc_id", "begin", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def shard_starts(file: DataFrame) -> DataFrame:
    """part, shard and how many ids come before it: sums within each part, then over the parts' totals (one row a range)."""
    sizes = file.select("part", "shard", "n_ids")
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", upto(Window.orderBy("part")).alias("before"))
    return sizes.withColumn("within", upto(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("at"))


def read(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a file, decoded shard by shard: doc_id, start, n_tokens, ids_crc32 (and the ids themselves)."""
    found = file.mapInArrow(_read(with_ids), "part int, shard int, doc_id long, begin long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.join(shard_starts(file), ["part", "shard"]).select("doc_id", (F.col("at") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
