"""Scores of texts by a deleted-interpolation bigram model whose counts cover the whole corpus.

The probability of a word after another is l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V + 1), where the three weights depend on
the frequency bucket of the context h. They are learned by expectation-maximisation: a tenth of the training documents
is deleted from the counts, and the weights maximise its likelihood; afterwards its counts join in again.

How it runs: documents are dealt to blocks of bounded size by a hash of doc_id (deleted documents to blocks of their
own). A block sends its distinct n-grams, sorted and delta-coded, with their counts to key ranges; a range adds up all
blocks' counts and answers each block with arrays in the order it asked. So a frequent word is one entry a block, every
n-gram is looked up exactly where it occurs, and no table of counts is ever in one place.

N-grams are 64-bit hashes of words and of pairs (pairs shortened to a width at which the expected number of colliding
pairs in the corpus is well below one).

Cases: null and empty texts are the end token alone; repeated rows are scored (and counted) each; a text of one word has
its start and end as contexts; without training documents only l0 / (V + 1) is left; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M1, crc_of_id, fields, mix64, pieces, save, text_bytes
from .packed import narrow, pack_keys, ranges, rows_table, unpack_keys, wide
from .words import coded_words, word_hashes

#: MB of a block's texts, entries of a key range, one in so many training documents deleted, context buckets.
BLOCK_MB, RANGE_ENTRIES, DELETED, BUCKETS, ROUNDS, SEED = 13.6, 1_500_000, 10, 20, 60, 31
#: Hashes of the end and of the start; no word has white space in it.
END, START = (int(x) for x in word_hashes([" end", " start"]))
HELD, DELETE, KEEP = 2, 1, 0
REQUEST = "gram int, part int, block int, deleted boolean, n int, first long, keys binary, counts binary"
ANSWER = "gram int, part int, block int, n int, kept binary, gone binary, n_kept long, n_gone long, v_kept long, v_all long"
CELLS = "bucket int, q2 int, q1 int, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Plan:
    """Sizes that follow from the input's."""

    def __init__(self, docs: DataFrame):
        size = text_bytes(docs)
        self.blocks = pieces(size, BLOCK_MB)
        self.deleted_blocks = max(1, -(-self.blocks // DELETED))
        self.parts = {1: max(1, int(size * 0.024) // RANGE_ENTRIES), 2: max(1, int(size * 0.1) // RANGE_ENTRIES)}
        self.bits = min(64, max(48, 2 * size.bit_length() - 3))

    def part(self, gram: int, keys: np.ndarray) -> np.ndarray:
        """The key range of each key; ascending with the key."""
        width = 64 if gram == 1 else self.bits
        return ((keys >> np.uint64(width - 24)) * np.uint64(self.parts[gram]) >> np.uint64(24)).astype(np.int64)


class Block:
    """The n-grams of a block's documents."""

    def __init__(self, table: pa.Table, plan: Plan):
        rows = table.combine_chunks()
        self.doc_ids, self.role = rows["doc_id"], rows["role"].to_numpy()
        codes, words, bounds = coded_words(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        n, docs = len(words), len(self.role)
        hashes = np.append(word_hashes(words), np.array([END, START], np.uint64))
        sizes = np.diff(bounds) + 1
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.word = np.full(self.bounds[-1], n, np.int64)  # code n: end
        at = np.ones(len(self.word), bool)
        at[self.bounds[1:] - 1] = False
        self.word[at] = codes
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.bounds[:-1]] = n + 1  # start
        self.doc = np.repeat(np.arange(docs), sizes)
        self.keys, self.index = {}, {}
        self.keys[1], place = np.unique(hashes[: n + 1], return_inverse=True)
        self.index[1] = place
        with np.errstate(over="ignore"):
            pair = mix64(hashes[self.context] * M1 + hashes[self.word]) >> np.uint64(64 - plan.bits)
        self.keys[2], self.index[2] = np.unique(pair, return_inverse=True)

    def counts(self, gram: int) -> np.ndarray:
        """Of each key, in the documents that are learned from."""
        learned = self.role[self.doc] != HELD
        which = self.index[1][self.word] if gram == 1 else self.index[2]
        return np.bincount(which[learned], minlength=len(self.keys[gram]))


def _ask(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        block = Block(table, plan)
        rows = []
        for gram in (1, 2):
            keys, counts = block.keys[gram], block.counts(gram)
            part = plan.part(gram, keys)
            for a, b in ranges(part):
                rows.append({"gram": gram, "part": int(part[a]), "block": table["block"][0].as_py(), "deleted": bool((block.role == DELETE).any()), "n": b - a, "first": int(keys[a].astype(np.int64)), "keys": pack_keys(keys[a:b]), "counts": narrow(counts[a:b])})
        return rows_table(REQUEST, rows)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Adds up a key range's counts over all blocks, in kept and in deleted documents."""
    rows = table.to_pylist()
    keys = [unpack_keys(r["first"], r["keys"], r["n"]) for r in rows]
    counts = np.concatenate([wide(r["counts"], r["n"]) for r in rows])
    deleted = np.repeat([r["deleted"] for r in rows], [r["n"] for r in rows])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    kept = np.bincount(inverse, np.where(deleted, 0, counts)).astype(np.int64)
    gone = np.bincount(inverse, np.where(deleted, counts, 0)).astype(np.int64)
    out, at = [], 0
    for r in rows:
        own = inverse[at : at + r["n"]]
        at += r["n"]
        out.append({k: r[k] for k in ("gram", "part", "block", "n")} | {"kept": narrow(kept[own]), "gone": narrow(gone[own])})
    total = {"n_kept": int(kept.sum()), "n_gone": int(gone.sum()), "v_kept": int((kept > 0).sum()), "v_all": int((kept + gone > 0).sum())}
    return rows_table(ANSWER, [*out, {"gram": rows[0]["gram"], "part": rows[0]["part"], "block": -1, "n": 0, **total}])


def _lookup(block: Block, answers: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts in kept and in deleted documents of each of the block's keys."""
    rows = sorted(answers.to_pylist(), key=lambda r: (r["gram"], r["part"]))
    out = {}
    for gram in (1, 2):
        own = [r for r in rows if r["gram"] == gram]
        out[gram] = tuple(np.concatenate([wide(r[side], r["n"]) for r in own] or [np.zeros(0, np.int64)]) for side in ("kept", "gone"))
        if len(out[gram][0]) != len(block.keys[gram]):
            raise ValueError("a block's documents changed between two reads of the input")
    return out


def _of_tokens(block: Block, uni: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(h), c(h, w) and c(w) of every token."""
    by_code = np.append(uni[block.index[1]], 0)
    by_code[-1] = by_code[-2]  # as many starts as ends
    return by_code[block.context], pair[block.index[2]], by_code[block.word]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0), BUCKETS - 1).astype(np.int64)


def _cells(plan: Plan, n_kept: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows_table(CELLS, [])
        block = Block(docs, plan)
        found = _lookup(block, answers)
        h, hw, w = _of_tokens(block, found[1][0], found[2][0])
        with np.errstate(divide="ignore"):
            q2 = np.where(hw > 0, np.round(-4 * np.log2(hw / np.maximum(h, 1))), -1).astype(np.int64)
            q1 = np.where(w > 0, np.round(-4 * np.log2(w / max(n_kept, 1))), -1).astype(np.int64)
        cells, n = np.unique((_bucket(h) << 32) | (q2 + 1 << 16) | (q1 + 1), return_counts=True)
        return pa.table({"bucket": pa.array(cells >> 32, pa.int32()), "q2": pa.array((cells >> 16 & 0xFFFF) - 1, pa.int32()), "q1": pa.array((cells & 0xFFFF) - 1, pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation; cells: bucket, quantised probabilities, tokens."""
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    for b in range(BUCKETS):
        own = np.array([c[1:] for c in cells if c[0] == b], np.float64).reshape(-1, 3)
        if not len(own):
            continue
        p = np.stack([np.where(own[:, k] >= 0, 2.0 ** (-own[:, k] / 4), 0.0) for k in (0, 1)] + [np.full(len(own), 1.0 / (vocabulary + 1))], 1)
        for _ in range(ROUNDS):
            share = p * out[b]
            share /= share.sum(1, keepdims=True)
            out[b] = np.maximum((share * own[:, 2:]).sum(0), 1e-9)
            out[b] /= out[b].sum()
        out[b] = np.maximum(out[b], 1e-7)
        out[b] /= out[b].sum()
    out[0] = [0.0, *out[0, 1:] / out[0, 1:].sum()]  # an unseen context has no bigram estimate
    return out


def _score(plan: Plan, n: int, v: int, weights: np.ndarray):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows_table(SCORES, [])
        block = Block(docs, plan)
        found = _lookup(block, answers)
        h, hw, w = _of_tokens(block, sum(found[1]), sum(found[2]))
        l2, l1, l0 = weights[_bucket(h)].T
        p = l2 * hw / np.maximum(h, 1) + l1 * w / max(n, 1) + l0 / (v + 1)
        base = np.log10((w + 0.1) / (n + 0.1 * (v + 1)))
        docs_n = len(block.role)
        add = lambda x: np.bincount(block.doc, x, docs_n)
        return pa.table(
            {
                "doc_id": block.doc_ids, "held_out": pa.array(block.role == HELD), "n_tokens": pa.array(np.diff(block.bounds), pa.int64()),
                "n_known": pa.array(add(w > 0).astype(np.int64)), "train_tokens": pa.array(np.full(docs_n, n), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p))),
            }
        )

    return run


def _dealt(docs: DataFrame, plan: Plan, role: Column) -> DataFrame:
    h = F.xxhash64("doc_id", "text", F.lit(SEED + 1))  # rows of one doc_id, or none, are dealt by their texts
    block = F.when(role == DELETE, plan.blocks + F.pmod(h, F.lit(plan.deleted_blocks))).otherwise(F.pmod(h, F.lit(plan.blocks)))
    return fields(docs, "doc_id", "text").select(block.cast("int").alias("block"), "doc_id", role.cast("int").alias("role"), "text")


def score(docs: DataFrame) -> DataFrame:
    """Scores of all documents by counts of those whose crc32(doc_id) mod 10 is not 0 (a null doc_id is learned from)."""
    plan = Plan(docs)
    held = F.coalesce(crc_of_id() % 10 == 0, F.lit(False))
    role = F.when(held, HELD).when(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(DELETED)) == 0, DELETE).otherwise(KEEP)
    dealt = _dealt(docs, plan, role)
    asked = dealt.groupBy("block").applyInArrow(_ask(plan), REQUEST)
    answers = save(asked.groupBy("gram", "part").applyInArrow(_answer, ANSWER), "lm-counts")
    sums = ["n_kept", "n_gone", "v_kept", "v_all"]
    n_kept, n_gone, v_kept, v_all = (x or 0 for x in answers.filter("block = -1 AND gram = 1").agg(*[F.sum(c) for c in sums]).first())
    replies = answers.filter("block >= 0").drop(*sums)

    def meet(d: DataFrame, a: DataFrame, f, schema: str) -> DataFrame:
        return d.groupBy("block").cogroup(a.groupBy("block")).applyInArrow(f, schema)

    cells = meet(dealt.filter(F.col("role") == DELETE), replies.filter(F.col("block") >= plan.blocks), _cells(plan, n_kept), CELLS)
    # at most buckets x quantised probabilities, whatever the input
    summed = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r["bucket"], r["q2"], r["q1"], r["n"]) for r in summed], v_kept)
    return meet(dealt, replies, _score(plan, n_kept + n_gone, v_all, weights), SCORES)
