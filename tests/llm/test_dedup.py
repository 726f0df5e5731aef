import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from ledgermill.llm import exact_dedup, jaccard_join


def norm(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_exact_groups_like_brute_force(docs, texts):
    groups = {}
    for i, t, *_ in texts:
        groups.setdefault(norm(t), []).append(i)
    got = sorted(tuple(r) for r in exact_dedup.dedup(docs).collect())
    assert got == sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), norm(t)) for i, t, *_ in texts)


def test_exact_with_a_history_table(spark):
    h = spark.createDataFrame([(9, "a b"), (3, "c")], "doc_id long, text string")
    d = spark.createDataFrame([(1, "a\tb"), (12, "c"), (13, "new"), (14, "new")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(d, h).collect()}
    assert got == {9: (1, 2), 1: (1, 2), 3: (3, 2), 12: (3, 2), 13: (13, 2), 14: (13, 2)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    blob = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    if not n:
        assert list(exact_dedup.find(blob, np.zeros(1, np.int64), blob)) == []
        return
    seeds, slots = exact_dedup.build_hash(blob)
    assert sorted(slots) == list(range(n))
    held = np.zeros_like(blob)
    held[slots] = blob
    assert (exact_dedup.find(blob, seeds, held) == slots).all()
    assert (exact_dedup.find(rng.integers(0, 256, (200, 32), dtype=np.uint8), seeds, held) == -1).all()


def test_keep_first_keeps_columns_and_one_of_repeats(docs, texts, empty):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(t) for _, t, *_ in texts})
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_exact_without_ids(spark, nameless):
    rows, docs = nameless
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    least = {h: min((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    got = sorted((tuple(r) for r in exact_dedup.dedup(docs).collect()), key=str)
    assert got == sorted(((i, least[norm(t)], len(groups[norm(t)]), i == least[norm(t)], norm(t)) for i, t, *_ in rows), key=str)
    kept = exact_dedup.keep_first(docs).collect()
    assert sorted(norm(r["text"]) for r in kept) == sorted(groups) and all(r["doc_id"] == least[norm(r["text"])] for r in kept)
    big = (1 << 53) + 1  # ids beyond the whole numbers of a double, beside a group without one, in history and after it
    old = spark.createDataFrame([(big, "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(big + 2, "a"), (5, "b"), (None, "d")], "doc_id long, text string")
    assert sorted({(r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(new, old).collect()}, key=str) == sorted({(big, 2), (5, 2), (None, 1)}, key=str)


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(texts, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        least.setdefault(find(a), []).append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    return sorted(((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_join_like_brute_force(docs, texts, k, percent):
    assert sorted((tuple(r) for r in jaccard_join.join(docs, k, percent).collect()), key=str) == components(texts, k, percent)


def test_join_of_long_lists_and_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    assert sorted((tuple(r) for r in jaccard_join.join(docs, 3, 85).collect()), key=str) == components(texts, 3, 85)


def test_join_of_frequent_tokens_that_few_classes_list(spark):
    common = [f"c{i}" for i in range(20)]
    a = " ".join(common)
    cls = lambda t: jaccard_join._class_of(jaccard_join.shingle_sets(pa.array([t]), 1)[0])
    b = next(t for k in range(99) if cls(t := " ".join([*common[1:], f"d{k}"])) % 2 != cls(a) % 2)
    rows = [(0, a), (1, b)] + [(10 + i, " ".join([*common, *(f"own{i}x{j}" for j in range(60))])) for i in range(jaccard_join.BLOCK + 50)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {i: max(0, i - 1) if i < 2 else i for i, _ in rows}


def test_join_of_a_frequent_passage_that_few_documents_list(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    own = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(60))) for i in range(jaccard_join.BLOCK + 400)]
    few = [(10_000 + k, f"{passage} last{k}") for k in range(4)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(own + few, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: i for i, _ in own} | {i: 10_000 for i, _ in few}


def test_join_without_ids_and_with_repeated_ones(nameless, monkeypatch):
    (rows, docs), k, percent = nameless, 5, 80
    assert sorted((tuple(r) for r in jaccard_join.join(docs, k, percent).collect()), key=str) == components(rows, k, percent)
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 1)  # members found by a join instead of the filter
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, k, percent).collect()]
    by_text = {}  # texts stand for rows: rows that repeat doc_id and text stay or go together
    every = sorted({(i, t) for i, t, *_ in rows}, key=str)
    comp = components([(n, t) for n, (i, t) in enumerate(every)], k, percent)
    for n, size, c in comp:
        by_text.setdefault(c if size else ("none", n), []).append(every[n])
    assert all(sum(x in kept for x in group) == 1 for group in by_text.values())
    assert all(i is not None for group in by_text.values() for i, t in group if (i, t) in kept and any(j is not None for j, _ in group))


def test_join_of_nothing(empty):
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).columns == empty.columns


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        y = np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64))
        far = sum((a ^ b if a ^ b >= 0 else (a ^ b) + (1 << 64)).bit_count() for a, b in zip(jaccard_join.parity_bits(x), jaccard_join.parity_bits(y), strict=True))
        assert far <= len(np.setxor1d(x, y))
