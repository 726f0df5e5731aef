"""Tokens of a column of texts by tables of bytes: each byte is kept, changed, separates words, or also ends a piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte that separates words becomes, and one that also ends a piece of text.
SPACE, BREAK = 32, 10


def byte_table(spaces: bytes, breaks: bytes = b"") -> np.ndarray:
    """A-Z become a-z; the bytes named separate words or end pieces; all others stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(spaces)] = SPACE
    table[list(breaks)] = BREAK
    return table


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column in a row, and where each text begins (and the end); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (every[bounds[0] : bounds[-1]], bounds - bounds[0]) if len(texts) else (every[:0], np.zeros(1, np.int64))


def coded_tokens(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of all words in a row, the distinct words (bytes), where each text's words begin (and the end), and each word's
    piece (a number that rises with every piece and text)."""
    raw, at = raw_bytes(texts)
    data = table[raw]
    inside = (data != SPACE) & (data != BREAK)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    first, last = np.flatnonzero(inside & (before | edge[:-1])), np.flatnonzero(inside & (after | edge[1:])) + 1
    ends = np.flatnonzero(data == BREAK)
    bounds = np.searchsorted(first, at)
    piece = np.searchsorted(ends, first) + np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    if not len(first):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), bounds, piece
    offsets = np.empty(2 * len(first), "<i8")  # words and what lies between them, in turn
    offsets[::2], offsets[1::2] = first, last
    both = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = both.take(pa.array(np.arange(0, len(offsets), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, bounds, piece


def runs(codes: np.ndarray, words: pa.Array, piece: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All runs of `least` to `most` consecutive words of one piece: where each begins, its code, and the distinct runs
    (words joined by one space)."""
    starts, found, names, base = [], [], [], 0
    at, code, distinct = np.arange(len(codes)), codes, words
    for width in range(1, most + 1):
        if width > 1:
            ok = at + width - 1 < len(codes)
            at, code = at[ok], code[ok]
            ok = piece[at] == piece[at + width - 1]
            at, code = at[ok], code[ok]
            pairs, code = np.unique(code * max(1, len(words)) + codes[at + width - 1], return_inverse=True)
            head, tail = distinct.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words))))
            distinct = pc.binary_join_element_wise(head, tail, pa.scalar(b" ", pa.large_binary()))
        if width >= least:
            starts.append(at)
            found.append(code + base)
            names.append(distinct)
            base += len(distinct)
    return np.concatenate(starts), np.concatenate(found), pa.concat_arrays(names)
