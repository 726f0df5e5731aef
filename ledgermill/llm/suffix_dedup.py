"""Removal of repeated passages by suffix arrays: bytes of any `width`-byte string that also starts in a document with a
smaller doc_id.

What is equal must meet in one task, so suffixes are ordered where they can be equal only. Three steps narrow that down:

1. Texts are packed in blocks of bounded bytes and cut at content-defined places. A piece that a smaller doc_id has as a
   whole is repeated as a whole: its strings are removed and, because the smaller doc_id has them all, need not be looked
   at again. This disposes of copies, however many, without ordering anything.
2. The strings that are left are dealt by seeds: of the hashes of a string's `gram`-byte parts, the least. Equal strings
   have equal seeds. Blocks ask key ranges which of their seeds other documents have too (sorted, delta-coded keys, one
   bit back); what is left by short parts is asked again by longer ones. Blocks send the contexts of what is left then:
   the bytes of all neighbouring strings of one seed. Equal contexts become one row with the least doc_id.
3. The contexts of a seed are one small text. Its suffix array is built by linear grouping (see grouping_sa), thousands
   of seeds at a time; neighbours in that order that agree in `width` bytes are equal strings, and the least doc_id of
   each such interval goes back to the contexts, blocks and documents.

A seed of very many different contexts is dealt again by seeds of longer parts, up to the string itself, where a seed has
one context: no group grows with the corpus. Pieces and contexts are told apart by 128-bit hashes and by their bytes.

Cases: null texts count as empty; texts shorter than `width` have nothing removed; a null doc_id comes after all others
(rows without one don't remove from each other, and neither do rows of one doc_id); rows of one doc_id are rows of their
own; an empty table gives no rows; columns other than doc_id and text are ignored. `width` is 8 at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, discard, fields, mix64, release, save, save_dealt, tidy
from .encoding import portions
from .grouping_sa import _spread, suffix_arrays
from .packed import narrow, pack_keys, ranges, rows_table, unpack_keys, wide
from .tokens import raw_bytes

#: In place of a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Bytes of a block's texts (or one text), of a key range's share, and about of a piece, as a power of two.
BLOCK, RANGE_KEYS, PIECE_BITS = 6_000_000, 2_000_000, 8
#: Lengths of parts that seeds are taken from; contexts of a seed above which the next length is used; bytes ordered at once.
GRAMS, MOST_CONTEXTS, ORDERED = (24, 40), 512, 1_000_000
#: Contexts of a seed above which the task that orders them takes the next length by itself.
MANY_CONTEXTS = 8
#: Elements that are hashed at once, so that they stay in a processor's cache.
SLICE = 1 << 16

PACKED = "block long, ids binary, named binary, sizes binary, data binary, cuts binary, keys binary, key1 long, key2 long, lo long, hi long"
ASKED = "block long, starts binary, ends binary, gram int, part int, n long, first long, keys binary, counts binary"
TOLD = "gram int, part int, block long, n long, shared binary"
CONTEXT = "block long, starts binary, ends binary, begins binary, places binary, place int, seed long, text binary, lo long, hi long"
LEAST = "seed long, text binary, least binary, lowest long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RUN = np.dtype([("n", "<u2"), ("least", "<i8")])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for o in range(min(8, len(out))):
        m = (len(data) - o) // 8
        out[o::8] = data[o : o + 8 * m].view("<u8")
    return out


def part_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all parts of so many bytes (8 at least)."""
    n = max(0, len(data) - length + 1)
    out = np.empty(n, np.uint64)
    offsets = [*range(8, length - 8, 8), length - 8] if length > 8 else []
    with np.errstate(over="ignore"):
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            eights = _eights(data[a : b + length - 1])
            h = eights[: b - a] * M1
            for o in offsets:
                h = (h ^ (h >> np.uint64(29))) * M2 + eights[o : o + b - a]
            out[a:b] = mix64(h)
    return out


def least_hashes(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The seed of each string of `width` bytes: the least hash of its parts of `gram` bytes."""
    h, window = part_hashes(data, gram), width - gram + 1
    if len(h) < window:
        return h[:0]
    out = np.empty(len(h) - window + 1, np.uint64)
    for a in range(0, len(out), SLICE):
        b = min(len(out), a + SLICE)
        m, size = h[a : b + window - 1], 1
        while 2 * size <= window:
            m, size = np.minimum(m[:-size], m[size:]), 2 * size
        out[a:b] = np.minimum(m[: b - a], m[window - size : window - size + b - a]) if size < window else m[: b - a]
    return out


def inside(at: np.ndarray, width: int) -> np.ndarray:
    """Whether the string of `width` bytes from each place on lies in one text; at: where texts begin, and the end."""
    out, tail = np.ones(int(at[-1]), bool), np.maximum(at[1:] - width + 1, at[:-1])
    out[_spread(tail, at[1:] - tail)] = False
    return out[: max(0, len(out) - width + 1)]


def stretches(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where neighbours that are ok begin and end."""
    change = np.flatnonzero(np.diff(ok, prepend=False, append=False))
    return change[::2], change[1::2]


def seed_runs(seed: np.ndarray, ok: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of one seed (see least_hashes) among those that are ok: first string, how many
    (width - gram + 1 at most), seed."""
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (seed[1:] != seed[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    most = width - gram + 1  # seeds that repeat (in periodic texts) make longer runs, which are cut
    n = -(-(end - start) // most)
    begin = _spread(np.zeros(len(n), np.int64), n) * most + np.repeat(start, n)
    return begin, np.minimum(begin + most, np.repeat(end, n)) - begin, np.repeat(seed[start], n)


def _collapse(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct key, and its least and greatest doc."""
    if not len(doc):
        return np.zeros(0, np.int64), doc, doc
    order = np.lexsort(keys)
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    at = np.flatnonzero(new)
    return order[at], np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at)


class Block:
    """A packed block: bytes of its texts in a row, where each begins, its doc_ids."""

    def __init__(self, row: dict):
        self.ids, self.named, sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["named"], bool), np.frombuffer(row["sizes"], "<i8")
        self.at = np.append(0, np.cumsum(sizes))
        self.data = np.frombuffer(pa.decompress(row["data"], int(self.at[-1]), codec="zstd"), np.uint8) if self.at[-1] else np.zeros(0, np.uint8)
        self.cuts, self.keys = np.frombuffer(row["cuts"], "<i8").reshape(-1, 2), np.frombuffer(row["keys"], "<u8").reshape(-1, 2)

    def runs(self, ok: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """seed_runs() of the strings that are ok; only their bytes are hashed."""
        start, end = stretches(ok)
        end = end + width - 1
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        data = np.concatenate([self.data[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)])
        at = np.append(0, np.cumsum(end - start))
        begin, n, seed = seed_runs(least_hashes(data, width, gram), inside(at, width), width, gram)
        return begin + (start - at[:-1])[np.searchsorted(at, begin, "right") - 1], n, seed

    def docs_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.at, places, "right") - 1]

    def left(self, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """Strings that the removed ranges of strings leave."""
        ok = inside(self.at, width)
        ok[_spread(starts, ends - starts)] = False
        return ok


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _one(block: int, n: int, names: list[str], schema: str, columns: dict) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    typed = dict(c.split() for c in schema.split(", "))
    columns = {"block": np.full(n, block)} | columns
    return pa.record_batch([pa.array(columns[c], kinds[typed[c]]) if c in columns else pa.nulls(n, kinds[typed[c]]) for c in names], names=names)


def _pack(width: int):
    """Texts as packed blocks, and the distinct pieces of each block with their least and greatest doc_id."""
    names = _names(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in portions(batch.column(1), BLOCK):
                yield from pack(batch.slice(a, b - a), block)
                block += 1

    def pack(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        data, at = raw_bytes(batch.column(1))
        ids = batch.column(0).fill_null(LAST).to_numpy().astype("<i8")
        ok = inside(at, width)
        cut = ok.copy()
        cut[1:] &= ~ok[:-1]  # a text's first string, or the hash says so
        part = part_hashes(data, min(width, GRAMS[0]))[: len(ok)]
        cut |= ok & (part & np.uint64((1 << PIECE_BITS) - 1) == 0)
        start, last = np.flatnonzero(cut), ok.copy()
        last[:-1] &= ~ok[1:] | cut[1:]
        end = np.flatnonzero(last) + width
        whole, h = data.tobytes(), xxhash.xxh3_128_digest
        keys = np.frombuffer(b"".join(h(whole[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)), "<u8").reshape(-1, 2)
        doc = ids[np.searchsorted(at, start, "right") - 1]
        first, lo, hi = _collapse([keys[:, 0], keys[:, 1]], doc)
        one = {
            "ids": [ids.tobytes()], "named": [batch.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes()], "sizes": [np.diff(at).astype("<i8").tobytes()],
            "data": [pa.compress(whole, codec="zstd", asbytes=True) if whole else b""], "cuts": [np.stack([start, end - width + 1]).T.astype("<i8").tobytes()], "keys": [keys.tobytes()],
        }
        yield _one(block, 1, names, PACKED, one)
        yield _one(block, len(first), names, PACKED, {"key1": keys[first, 0].view(np.int64), "key2": keys[first, 1].view(np.int64), "lo": lo, "hi": hi})

    return run


def _own(told: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of strings that repeated pieces of a block remove."""
    row = next(r for r in told if r["starts"] is not None and r.get("gram") is None)
    return np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["ends"], "<i8")


def _still(b: Block, told: list[dict], width: int) -> np.ndarray:
    """Strings that are left by pieces and by the seeds before the last that were asked."""
    row = next((r for r in told if r["starts"] is not None and r["gram"] is not None), None)
    if row is None:
        return b.left(*_own(told), width)
    ok, starts = np.zeros(max(0, len(b.data) - width + 1), bool), np.frombuffer(row["starts"], "<i8")
    ok[_spread(starts, np.frombuffer(row["ends"], "<i8") - starts)] = True
    return ok


def _shared(b: Block, ok: np.ndarray, told: list[dict], width: int, gram: int, bits: int) -> np.ndarray:
    """Of the strings that are ok, those whose seeds other documents have too, by the answers to what a block has asked."""
    begin, n, seed = b.runs(ok, width, gram)
    asked, place = np.unique(mix64(seed) >> np.uint64(64 - bits), return_inverse=True)
    answers = sorted((r for r in told if r["gram"] == gram and r["part"] is not None), key=lambda r: r["part"])
    shared = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"], bitorder="little") for r in answers]]).astype(bool)
    if len(shared) != len(asked):
        raise ValueError("answers do not fit a block's seeds")
    mine = shared[place]
    out = np.zeros(len(ok), bool)
    out[_spread(begin[mine], n[mine])] = True
    return out


def _ask(width: int, grams: list[int], parts: int, bits: int):
    """The last of these grams' seeds of the strings that pieces and the seeds before have left; with the first gram, also
    the ranges of strings that repeated pieces remove, with later ones the ranges of strings that are left."""

    def run(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        for row in blocks.to_pylist():
            b, told_rows = Block(row), told.to_pylist()
            if len(grams) == 1:
                least = {(r["key1"], r["key2"]): r["least"] for r in told_rows}
                known = np.array([least.get(k, LAST) for k in zip(*b.keys.view(np.int64).T.tolist(), strict=True)] if len(b.keys) else [], np.int64)
                gone = known < b.docs_at(b.cuts[:, 0])
                starts, ends = b.cuts[gone, 0], b.cuts[gone, 1]
                rows.append({"block": row["block"], "starts": starts.tobytes(), "ends": ends.tobytes()})
                ok = b.left(starts, ends, width)
            else:
                ok = _shared(b, _still(b, told_rows, width), told_rows, width, grams[-2], bits)
                starts, ends = stretches(ok)
                rows.append({"block": row["block"], "gram": grams[-1], "starts": starts.astype("<i8").tobytes(), "ends": ends.astype("<i8").tobytes()})
            begin, _, seed = b.runs(ok, width, grams[-1])
            hashed, doc = mix64(seed) >> np.uint64(64 - bits), np.searchsorted(b.at, begin, "right")
            order = np.lexsort((doc, hashed))
            hashed, doc = hashed[order], doc[order]
            new = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.zeros(0, np.int64)
            several = (doc[new] != doc[np.append(new[1:], len(doc)) - 1]) + 1 if len(new) else new
            asked = hashed[new]
            part = ((asked >> np.uint64(bits - 24)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
            rows += [{"block": row["block"], "gram": grams[-1], "part": int(part[x]), "n": y - x, "first": int(asked[x]), "keys": pack_keys(asked[x:y]), "counts": narrow(several[x:y])} for x, y in ranges(part) if len(part)]
        tidy()
        return rows_table(ASKED, rows)

    return run


def _tell(table: pa.Table) -> pa.Table:
    """For each block's seeds of a range, in the order asked, a bit: whether several documents have the seed."""
    rows = table.to_pylist()
    _, place = np.unique(np.concatenate([unpack_keys(r["first"], r["keys"], r["n"]) for r in rows]), return_inverse=True)
    shared = (np.bincount(place, np.concatenate([wide(r["counts"], r["n"]) for r in rows])) > 1)[place]
    ends = np.cumsum([r["n"] for r in rows])
    tidy()
    return rows_table(TOLD, [{"gram": r["gram"], "part": r["part"], "block": r["block"], "n": r["n"], "shared": np.packbits(shared[e - r["n"] : e], bitorder="little").tobytes()} for r, e in zip(rows, ends.tolist(), strict=True)])


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """These ranges of bytes as a binary array."""
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype("<i8")), pa.py_buffer(data[_spread(start, size)])])


def _contexts(width: int, grams: list[int], bits: int):
    """The distinct contexts, by seeds of the first gram, of the strings that are left, with their least and greatest
    doc_id; and where in the block they are."""

    def run(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            b, told_rows = Block(row), told.to_pylist()
            starts, ends = _own(told_rows)
            ok = _shared(b, _still(b, told_rows, width), told_rows, width, grams[-1], bits)
            begin, n, seed = b.runs(ok, width, grams[0])
            texts = _cut_out(b.data, begin, n + width - 1).dictionary_encode()
            index = texts.indices.to_numpy()
            first, lo, hi = _collapse([index], b.docs_at(begin))
            picked = texts.dictionary.take(pa.array(index[first]))
            out.append(_one(row["block"], 1, _names(CONTEXT), CONTEXT, {"starts": [starts.tobytes()], "ends": [ends.tobytes()], "begins": [begin.astype("<i8").tobytes()], "places": [index.astype("<i4").tobytes()]}))
            columns = {"place": index[first].astype(np.int32), "seed": seed[first].view(np.int64), "text": picked.cast(pa.binary()), "lo": lo, "hi": hi}
            out.append(_one(row["block"], len(first), _names(CONTEXT), CONTEXT, columns))
        tidy()
        return pa.Table.from_batches(out) if out else rows_table(CONTEXT, [])

    return run


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that an array's values lie in, and where each begins, and the end."""
    raw = texts.cast(pa.large_binary())
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]


def _alike(seed: np.ndarray) -> np.ndarray:
    """For each row, how many rows have its seed (they are neighbours)."""
    first = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    n = np.diff(np.append(first, len(seed)))
    return np.repeat(n, n)


def order_seeds(seed: np.ndarray, texts: pa.Array, lo: np.ndarray, width: int, grams: list[int]) -> np.ndarray:
    """For each string of each context, one after the other, the least doc_id among all contexts of its seed (rows of one
    seed are neighbours; a seed's contexts differ). Seeds of many contexts are dealt by parts of the next of these lengths,
    as the number of steps that order texts together is the longest text's."""
    strings = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - width + 1
    least, at, alike = np.repeat(lo, strings), np.append(0, np.cumsum(strings)), _alike(seed)
    many = (alike > MANY_CONTEXTS) & (len(grams) > 0)
    few = (alike > 1) & ~many  # the only context of its seed needs no order
    if few.any():
        least[_spread(at[:-1][few], strings[few])] = np.concatenate(order_contexts(seed[few], texts.filter(pa.array(few)), lo[few], width))
    if many.any():
        data, begins = _bytes_of(texts.filter(pa.array(many)))
        data, begins = data[begins[0] : begins[-1]], begins - begins[0]
        begin, n, part = seed_runs(least_hashes(data, width, grams[0]), inside(begins, width), width, grams[0])
        cut = _cut_out(data, begin, n + width - 1).dictionary_encode()
        index = cut.indices.to_numpy()
        first, least_of, _ = _collapse([index], lo[many][np.searchsorted(begins, begin, "right") - 1])
        order = np.argsort(part[first], kind="stable")
        first, least_of = first[order], least_of[order]
        found = order_seeds(part[first], cut.dictionary.take(pa.array(index[first])), least_of, width, grams[1:])
        starts = np.empty(len(cut.dictionary), np.int64)
        starts[index[first]] = np.cumsum(n[first]) - n[first]
        least[_spread(at[:-1][many], strings[many])] = found[_spread(starts[index], n)]
    return least


def order_contexts(seed: np.ndarray, texts: pa.Array, lo: np.ndarray, width: int) -> list[np.ndarray]:
    """As order_seeds(), an array a context, from one suffix array a seed."""
    data, at = _bytes_of(texts)
    size = np.diff(at)
    new = np.append(True, seed[1:] != seed[:-1])
    text = np.cumsum(new) - 1
    # contexts one after the other, each with a 1 behind it, a seed's last also with a 0
    ends_text = np.append(new[1:], True)
    begin = np.append(0, np.cumsum(size + 1 + ends_text))[:-1]
    symbols = np.ones(int(begin[-1] + size[-1] + 2), np.int64)
    places = _spread(begin, size)
    symbols[places] = data[_spread(at[:-1], size)].astype(np.int64) + 2
    bounds = np.append(begin[new], len(symbols))
    symbols[bounds[1:] - 1] = 0
    order = suffix_arrays(symbols, bounds)
    row = np.full(len(symbols), -1)  # of strings that lie in one context
    strings = size - width + 1
    starts = _spread(begin, strings)
    row[starts] = np.repeat(np.arange(len(size)), strings)
    order = order[row[order] >= 0]
    eights = _eights(np.append(symbols, np.zeros(8, np.int64)).astype(np.uint8))  # a byte plus two, as a byte: still one value each
    same = text[row[order][1:]] == text[row[order][:-1]]
    a, b = order[1:][same], order[:-1][same]
    agree = np.ones(len(a), bool)
    for o in [*range(0, width - 8, 8), width - 8]:
        agree &= eights[a + o] == eights[b + o]
    same[np.flatnonzero(same)[~agree]] = False
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.empty(len(symbols), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(lo[row[order]], heads), np.diff(np.append(heads, len(order))))
    return np.split(least[starts], np.cumsum(strings)[:-1])


def _runs_of(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each of the stretches of so many values: equal neighbours as (how many, value)."""
    new = np.append(True, values[1:] != values[:-1])
    begin = np.cumsum(sizes) - sizes
    new[begin] = True
    first = np.flatnonzero(new)
    out = np.empty(len(first), _RUN)
    out["n"], out["least"] = np.diff(np.append(first, len(values))), values[first]
    at = np.append(np.searchsorted(first, begin), len(first)) * _RUN.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype("<i8")), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _ordered(width: int, grams: list[int]):
    """A stream sorted by seed: whole seeds, so many bytes at a time, are ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a, b in portions(batch.column(1), ORDERED):
                held.append(batch.slice(a, b - a))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py()
                if size >= ORDERED:
                    table = pa.Table.from_batches(held)
                    seeds = table["seed"].to_numpy()
                    cut = int(np.searchsorted(seeds, seeds[-1]))
                    if cut:
                        yield from order(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), 0 if cut else size
        if held:
            yield from order(pa.Table.from_batches(held))

    def order(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        seed, lo = table["seed"].to_numpy(), table["lo"].to_numpy()
        texts = pa.concat_arrays([x.cast(pa.large_binary()) for x in table["text"].chunks])
        strings = pc.binary_length(texts).to_numpy() - width + 1
        least = order_seeds(seed, texts, lo, width, grams)
        yield pa.record_batch([pa.array(seed), texts.cast(pa.binary()), _runs_of(least, strings), pa.array(np.minimum.reduceat(least, np.cumsum(strings) - strings))], names=["seed", "text", "least", "lowest"])
        tidy()

    return run


def _deal_again(width: int, gram: int):
    """Contexts cut into those of seeds of longer parts, with the context that they come from and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in portions(batch.column(1), ORDERED):
                part = batch.slice(x, y - x)
                data, at = _bytes_of(part.column(1))
                data, at = data[at[0] : at[-1]], at - at[0]
                begin, n, seed = seed_runs(least_hashes(data, width, gram), inside(at, width), width, gram)
                of = np.searchsorted(at, begin, "right") - 1
                take = pa.array(of)
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array((begin - at[of]).astype(np.int32)), pa.array(seed.view(np.int64)), _cut_out(data, begin, n + width - 1).cast(pa.binary()), part.column(2).take(take), part.column(3).take(take)],
                    names=["of_seed", "of_text", "place", "seed", "text", "lo", "hi"],
                )

    return run


def least_docs(contexts: DataFrame, width: int, grams: list[int], held: list[DataFrame]) -> DataFrame:
    """seed, text, least (the least doc_id of each string, as runs) and lowest of distinct contexts (seed, text, lo, hi).

    held takes the tables written on the way, which the result reads.
    """
    counts = contexts.groupBy("seed").agg(F.count("*").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    # a seed of one document repeats nothing
    counts = counts.filter("first < last")
    cold, hot = counts.filter(F.col("n") <= MOST_CONTEXTS), counts.filter(F.col("n") > MOST_CONTEXTS)
    mine = contexts if len(grams) == 1 else contexts.join(cold.select("seed"), "seed", "left_semi")
    out = mine.select("seed", "text", "lo").repartition("seed").sortWithinPartitions("seed").mapInArrow(_ordered(width, grams[1:]), LEAST)
    if len(grams) == 1 or hot.isEmpty():
        return out
    dealt = contexts.join(hot.select("seed"), "seed", "left_semi").select("seed", "text", "lo", "hi")
    dealt = save(dealt.mapInArrow(_deal_again(width, grams[1]), "of_seed long, of_text binary, place int, seed long, text binary, lo long, hi long"), "suffix-dealt")
    again = save(dealt.groupBy("seed", "text").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "suffix-contexts")
    held += [dealt, again]
    found = least_docs(again, width, grams[1:], held)
    # what the next level leaves out belongs to one document: its own least
    back = dealt.join(found, ["seed", "text"], "left").select("of_seed", "of_text", "place", F.coalesce("lowest", "lo").alias("lowest"), "least", "lo", (F.octet_length("text") - width + 1).alias("n"))
    back = back.groupBy("of_seed", "of_text").agg(F.sort_array(F.collect_list(F.struct("place", "least", "lo", "n"))).alias("runs"), F.min("lowest").alias("lowest"))
    back = back.select(F.col("of_seed").alias("seed"), F.col("of_text").alias("text"), "runs", "lowest").mapInArrow(_joined, LEAST)
    return out.unionByName(back)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a context's parts as its own."""
    for batch in batches:
        least = []
        for parts in batch.column(2).to_pylist():
            least.append(b"".join(np.array([(p["n"], p["lo"])], _RUN).tobytes() if p["least"] is None else p["least"] for p in parts))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(least, pa.binary()), batch.column(3)], names=["seed", "text", "least", "lowest"])


def _known_by() -> list[Column]:
    return [F.col("seed"), F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2")]


def _remove(width: int):
    def run(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            b, mine = Block(row), told.filter(pc.is_valid(told["starts"])).to_pylist()
            own, (starts, ends) = mine[0], _own(mine)
            change = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, ends + width - 1, -1)
            least = told.filter(pc.is_valid(told["place"])).select(["place", "least"]).combine_chunks()
            if least.num_rows:
                begin, place = np.frombuffer(own["begins"], "<i8"), np.frombuffer(own["places"], "<i4")
                row_of = np.full(int(place.max()) + 1, -1)
                row_of[least["place"].to_numpy()] = np.arange(least.num_rows)
                mine = np.flatnonzero(row_of[place] >= 0)
                data, at = _bytes_of(pa.concat_arrays([x.cast(pa.large_binary()) for x in least["least"].chunks]))
                runs, at = np.frombuffer(data[at[0] : at[-1]], _RUN), (at - at[0]) // _RUN.itemsize
                sizes = np.diff(at)[row_of[place[mine]]]
                runs = runs[_spread(at[row_of[place[mine]]], sizes)]
                n = runs["n"].astype(np.int64)
                # each run's place in its context: what the runs before it in the context sum up to
                before = np.cumsum(n) - n
                at = np.repeat(begin[mine], sizes) + before - np.repeat(before[np.cumsum(sizes) - sizes], sizes)
                hit = runs["least"] < np.repeat(b.docs_at(begin[mine]), sizes)
                np.add.at(change, at[hit], 1)
                np.add.at(change, at[hit] + n[hit] + width - 1, -1)
            gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[b.at[:-1][np.diff(b.at) > 0]] |= gone[b.at[:-1][np.diff(b.at) > 0]]
            removed, spans = (np.append(0, np.cumsum(x)) for x in (gone, first))
            kept = []
            for x, y in zip(b.at[:-1].tolist(), b.at[1:].tolist(), strict=True):
                kept.append(hashlib.sha256(b.data[x:y] if removed[y] == removed[x] else b.data[x:y][~gone[x:y]]).hexdigest())
            size = np.diff(b.at)
            out.append(pa.table({"doc_id": pa.array(b.ids, mask=~b.named), "n_bytes": size, "n_removed": np.diff(removed[b.at]), "n_spans": np.diff(spans[b.at]), "kept_sha256": kept}))
        tidy()
        return pa.concat_tables(out) if out else rows_table(RESULT.replace("string", "binary"), [])

    return run


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left) of every row of docs."""
    if width < 8:
        raise ValueError("width must be 8 or more")
    spark = docs.sparkSession
    grams = [*[g for g in GRAMS if g < width], width]
    asking = grams[:-1] or grams
    blocks = save_dealt(fields(docs, "doc_id", "text").mapInArrow(_pack(width), PACKED), "suffix-blocks", "block")
    release(spark)
    packed = blocks.filter("ids IS NOT NULL").select("block", "ids", "named", "sizes", "data", "cuts", "keys")
    mine = blocks.filter("ids IS NULL").select("block", "key1", "key2", "lo", "hi")
    every = mine.groupBy("key1", "key2").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least < most").drop("most")
    told = mine.join(every, ["key1", "key2"]).filter("least < hi").select(F.col("block").alias("of"), "key1", "key2", "least")
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts, bits = max(1, int(size * 0.2) // RANGE_KEYS), 48
    none = lambda *names: [F.lit(None).cast(k).alias(c) for c, k in names]

    def meet(told: DataFrame, f, schema: str, name: str) -> DataFrame:
        out = save(packed.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(f, schema), name)
        release(spark)
        return out

    spans, held = None, []
    for k in range(len(asking)):
        asked = meet(told, _ask(width, asking[: k + 1], parts, bits), ASKED, "suffix-seeds")
        told = asked.filter("part IS NULL").select(F.col("block").alias("of"), "starts", "ends", "gram", *none(("part", "int"), ("n", "long"), ("shared", "binary")))
        if spans is None:
            spans = told
        else:
            told = spans.unionByName(told)
        answers = asked.filter("part IS NOT NULL").select("gram", "part", "block", "n", "first", "keys", "counts").groupBy("part").applyInArrow(_tell, TOLD)
        answers = save(answers, "suffix-shared")
        told = told.unionByName(answers.select(F.col("block").alias("of"), *none(("starts", "binary"), ("ends", "binary")), "gram", "part", "n", "shared"))
        held += [asked, answers]
    contexts = meet(told, _contexts(width, asking, bits), CONTEXT, "suffix-contexts")
    discard(*held)
    own = contexts.filter("place IS NOT NULL").select("block", "place", "seed", "text", "lo", "hi")
    distinct = save(own.groupBy("seed", "text").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "suffix-distinct")
    on_the_way = [distinct]
    # from here on contexts are known by 128 bits of their hashes
    found = least_docs(distinct, width, grams, on_the_way).filter("lowest < " + str(LAST)).select(*_known_by(), "least", "lowest")
    found = save(found, "suffix-least")
    discard(*on_the_way)
    release(spark)
    back = own.select("block", "place", "hi", *_known_by()).join(found, ["seed", "key1", "key2"]).filter("lowest < hi").select(F.col("block").alias("of"), *none(("starts", "binary"), ("ends", "binary"), ("begins", "binary"), ("places", "binary")), "place", "least")
    places = contexts.filter("place IS NULL").select(F.col("block").alias("of"), "starts", "ends", "begins", "places", *none(("place", "int"), ("least", "binary")))
    out = meet(places.unionByName(back), _remove(width), RESULT, "suffix-result")
    discard(blocks, contexts, found)
    return out
