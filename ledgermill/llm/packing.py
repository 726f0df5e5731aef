"""Packing of token ids into fixed sequences: first-fit decreasing over a tournament tree, in randomised groups.

Each document goes to a group by a keyed hash of its doc_id and text, so groups are alike whatever the sources, and each
is packed on its own in bounded memory. In a group, whole sequences are cut off long documents first; what is left is
placed by first-fit decreasing, where a tournament tree over bin capacities finds the leftmost bin that fits in
logarithmic time. That decides which documents lie together. A second step decides the padding: the emptiest bins give
their tokens, cut where needed, to the gaps of the fullest, so that at most one sequence of a group is not full.

Cases: null and empty texts are documents of the end id alone; rows with the same doc_id are packed each (in the order
of their ids); a document longer than a sequence is cut; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, pieces, text_bytes, tidy
from .encoding import Encoder, id_type, portions, vocabulary_size

#: Tokens of a sequence, MB of texts that make a group, and the key of the groups' hash.
CAPACITY, GROUP_MB, SEED = 2048, 4.0, 20_011
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """A complete binary tree whose leaves are the room in bins; each inner node is the larger of its children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.node = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The leftmost bin with that much room, which is taken; all bins together must have one."""
        node, i = self.node, 1
        while i < self.leaves:
            i *= 2
            if node[i] < size:
                i += 1
        node[i] -= size
        bin_, i = i - self.leaves, i // 2
        while i:
            top = max(node[2 * i], node[2 * i + 1])
            if node[i] == top:
                break
            node[i] = top
            i //= 2
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; larger sizes go first, equal ones in their order, each to the leftmost bin with room."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.place(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths; all but one sequence are full."""
    full, rest = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(d, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, whole, n - whole))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    i, j = 0, len(bins) - 1
    while i < j:
        room = capacity - sum(p[2] for p in bins[i])
        while room and i < j:
            d, at, n = bins[j].pop()
            give = min(room, n)
            bins[i].append((d, at, give))
            room -= give
            if give < n:
                bins[j].append((d, at + give, n - give))
            if not bins[j]:
                j -= 1
        i += 1
    return full + [b for b in bins if b]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.of(path)
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for a, b in portions(batch.column(2), 12_000_000):
                part = batch.slice(a, b - a)
                ids, offsets = coder.encode(part.column(2))
                raw, at = ids.tobytes(), (offsets * coder.dtype.itemsize).tolist()
                yield pa.record_batch([part.column(0), part.column(1), pa.array([raw[s:e] + end for s, e in zip(at, at[1:])], pa.binary())], names=["grp", "doc_id", "ids"])

    return run


def _pack(dtype: str, capacity: int, with_ids: bool):
    def run(table: pa.Table) -> pa.Table:
        docs = sorted(zip(table["doc_id"].to_pylist(), table["ids"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        arrays = [np.frombuffer(x, dtype).astype("<u4") for _, x in docs]
        base = table["grp"][0].as_py() << 32
        columns: dict[str, list] = {c.split()[0]: [] for c in (PIECES + ", ids binary" * with_ids).split(", ")}
        for s, sequence in enumerate(pack_lengths([len(x) for x in arrays], capacity)):
            offset = 0
            for d, at, n in sequence:
                piece = arrays[d][at : at + n].tobytes()
                for name, value in (("doc_id", docs[d][0]), ("start", at), ("length", n), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", len(arrays[d])), ("sequence_id", base + s), ("offset", offset)):
                    columns[name].append(value)
                if with_ids:
                    columns["ids"].append(piece)
                offset += n
        tidy()
        return pa.table({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in columns.items()})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, group_mb: float = GROUP_MB) -> DataFrame:
    """Pieces of all documents and their places in sequences; with_ids adds each piece's ids (little-endian 32 bits)."""
    groups = pieces(text_bytes(docs), group_mb)
    keyed = fields(docs, "doc_id", "text").select(F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(groups)).cast("int").alias("grp"), "doc_id", "text")
    coded = keyed.mapInArrow(_encode(tokenizer, end_id), "grp int, doc_id long, ids binary")
    dtype = id_type(vocabulary_size(tokenizer)).str
    return coded.groupBy("grp").applyInArrow(_pack(dtype, capacity, with_ids), PIECES + ", ids binary" * with_ids)

