"""Sorted keys and counts as compact binary, for shuffles of many small numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def narrow(x: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or x.max() < 1 << 8 * np.dtype(k).itemsize)
    return x.astype(kind).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of ascending keys, in as many bytes as the largest needs."""
    steps = np.diff(keys).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(first: int, data: bytes, n: int) -> np.ndarray:
    keys = np.empty(n, np.uint64)
    keys[0] = np.uint64(first & (1 << 64) - 1)
    if n > 1:
        width = len(data) // (n - 1)
        steps = np.zeros((n - 1, 8), np.uint8)
        steps[:, :width] = np.frombuffer(data, np.uint8).reshape(n - 1, width)
        with np.errstate(over="ignore"):
            keys[1:] = keys[0] + np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)
    return keys


def rows_table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[k]) for n, k in (c.split() for c in schema.split(", "))})


def ranges(part: np.ndarray) -> list[tuple[int, int]]:
    """Where each value of an ascending array begins and ends."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
