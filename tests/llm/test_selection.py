import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from ledgermill.llm import collocations, importance, suffix_dedup
from ledgermill.llm.grouping_sa import suffix_arrays

LAST = (1 << 63) - 1
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def features_of(t, least, most):
    w = words_of(t)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def drawn(rows, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features_of(x, least, most)) for xs in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * float(all_s + buckets) / ((s[bucket(f)] + 1) * float(all_t + buckets))))
    out = []
    for i, x in rows:
        f = features_of(x, least, most)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    order = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], LAST if r[0] is None else r[0]))
    for rank, r in enumerate(order[: len(order) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("least", "most", "percent"), [(1, 1, 10), (1, 2, 50), (2, 3, 100)])
def test_resampling_like_brute_force(spark, docs, texts, monkeypatch, least, most, percent):
    monkeypatch.setattr(importance, "PORTION", 20_000)
    target = ["the stone house", None, "", "Water with THE stone", texts[3][1]]
    got = importance.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), least, most, 997, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    wanted = drawn([(i, t) for i, t, *_ in texts], target, least, most, 997, percent)
    # rows of one doc_id and score have their ranks in any order
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted


def test_resampling_without_ids_and_of_nothing(spark, nameless, empty):
    rows, docs = nameless
    target = spark.createDataFrame([("water",)], "text string")
    got = sorted((tuple(r)[:4] for r in importance.resample(docs, target, percent=50).collect()), key=str)
    assert got == sorted((r[:4] for r in drawn([(i, t) for i, t, *_ in rows], ["water"], percent=50)), key=str)
    ranks = sorted(r[0] for r in importance.draw(docs, target, percent=50).select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(rows)


def test_ranks_over_partitions(spark):
    df = spark.range(5000).selectExpr("id % 700 AS score", "id AS doc_id").repartition(9)
    from pyspark.sql import functions as F

    got = importance.ranked(df, F.desc("score"), F.asc("doc_id")).orderBy("rank").collect()
    assert [(r["rank"], r["score"], r["doc_id"]) for r in got] == [(k, s, i) for k, (s, i) in enumerate(sorted(((i % 700, i) for i in range(5000)), key=lambda r: (-r[0], r[1])), 1)]


def mined(rows, most, support, percent, first):
    f = {}
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c = f.setdefault(lang or "und", Counter())
            for k in range(1, most + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: n for p, n in c.items() if len(p) > 1 and n >= support}
        rows_ = []
        for p, a in frequent.items():
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * n >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in frequent.items() if len(q) > len(p))
            if not inside:
                rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(v for p, v in c.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize(("most", "support", "percent", "first", "bits"), [(3, 10, 50, 2000, None), (3, 3, 50, 25, 20), (4, 3, 80, 2000, 16), (2, 4, 50, 50, 16)])
def test_collocations_like_brute_force(spark, docs, texts, monkeypatch, most, support, percent, first, bits):
    monkeypatch.setattr(collocations, "PORTION", 30_000)
    extra = [(900, "Über die Straße, über die Straße; über die\tStraße. über die!straße\vüber  die\fx", "de"), (901, "a\x00b a\x00b \xa0 c", None), (902, "no lang", "und")]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra * 3, "doc_id long, text string, lang string"))
    got = collocations.mine(both, most, support, percent, first, bits)
    assert sorted(tuple(r) for r in got.collect()) == mined([(lang, t) for _, t, lang, _ in texts] + [(lang, t) for _, t, lang in extra * 3], most, support, percent, first)


def test_bitmaps_prune_but_lose_nothing(spark, docs, texts):
    every = collocations.frequencies(docs, 2, 3, 16)
    counts = Counter()
    for _, t, lang, _ in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", f"{a} {b}") for a, b in zip(w, w[1:]))
    assert {(r["lang"], r["phrase"]): r["n"] for r in every[1].collect()} == {k: n for k, n in counts.items() if n >= 3}


def test_collocations_of_nothing_and_of_large_counts(spark, empty, nameless):
    assert collocations.mine(empty).count() == 0
    rows, docs = nameless
    assert sorted(tuple(r) for r in collocations.mine(docs, 3, 2).collect()) == mined([(lang, t) for _, t, lang, _ in rows], 3, 2, 50, 2000)
    big = 3 * 10**13 + 1  # products beyond 64 bits
    table = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    got = collocations.candidates([table([("x", "a", big), ("x", "b", big + 7)]), table([("x", "a b", big - 5)])], 10).first()
    assert got["score"] == 1_000_000 * (big - 5) ** 2 // (big * (big + 7))


def test_suffix_arrays_of_many_texts():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 60))] + [0] for _ in range(rng.randint(1, 6))]
        texts += [[]] if rng.random() < 0.3 else []
        bounds = np.cumsum([0] + [len(t) for t in texts])
        order = suffix_arrays(np.array([x for t in texts for x in t], np.int64), bounds)
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert (order[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def unrepeated(rows, width):
    first = {}
    for i, t in rows:
        b, d = (t or "").encode(), LAST if i is None else i
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(d, first.get(b[p : p + width], d))
    out = []
    for i, t in rows:
        b, d = (t or "").encode(), LAST if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(5)
    vocabulary = ["wasser", "straße", "house", "and", "the", "über", "x1", "stone"]
    base = [" ".join(rng.choice(vocabulary) + str(rng.randint(0, 30)) for _ in range(150)) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            parts += [b[a : a + rng.randint(1, 600)], " ".join(str(rng.randint(0, 10**9)) for _ in range(rng.choice([0, 20])))]
        t = "".join(parts)
        k = rng.randrange(len(t) + 1)
        rows.append((i, t[:k] + "#" * rng.randint(0, 1) + t[k:]))
    rows += [(None, base[0]), (None, base[0] + "q"), (None, None), (200, None), (201, ""), (202, "x" * 5000), (203, "x" * 49), (204, "y" + "x" * 60), (7, base[1]), (7, base[1]), (205, "abab" * 300), (206, "ba" * 40), (207, "\x00\xff" * 80)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "contexts"), [(50, 512), (50, 2), (30, 1), (8, 512)])
def test_repeats_like_brute_force(spark, monkeypatch, width, contexts):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", contexts)  # beyond that, seeds of longer parts
    monkeypatch.setattr(suffix_dedup, "BLOCK", 15_000)
    monkeypatch.setattr(suffix_dedup, "ORDERED", 4_000)
    rows = passages()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, seed int").repartition(3)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, width).collect()), key=str) == unrepeated(rows, width)


def test_repeats_of_documents(docs, texts, empty):
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=str) == unrepeated([(i, t) for i, t, *_ in texts], 50)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="8 or more"):
        suffix_dedup.remove_repeats(docs, 7)


def test_long_passages_like_brute_force(spark):
    """Over 255 neighbouring strings of one seed and one least doc_id."""
    rng = random.Random(6)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(40)]
    rows = [r for i, base in enumerate(bases) for r in ((2 * i, base), (2 * i + 1, "z" + base[100:1400] + "q"))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 700).collect()
    assert sorted((tuple(r) for r in got), key=str) == unrepeated(rows, 700)


def test_seeds_of_many_contexts_are_ordered_in_short_texts(monkeypatch):
    """What texts ordered together cost in steps is the longest one's symbols: many contexts of a seed are dealt again."""
    rng, longest = random.Random(7), []
    common = "".join(rng.choice("abcdef ") for _ in range(50))
    texts = sorted({"".join(rng.choice("xyz") for _ in range(rng.randint(1, 12))) + common[rng.randint(0, 4) : rng.randint(44, 50)] + rng.choice(["x", "yy", "zx"]) for _ in range(60)} - {""})
    texts = [t for t in texts if len(t) >= 50]
    assert len(texts) > 20
    lo = [rng.randint(0, 1000) for _ in texts]
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda symbols, bounds: longest.append(int(np.diff(bounds).max())) or suffix_arrays(symbols, bounds))
    got = suffix_dedup.order_seeds(np.ones(len(texts), np.int64), pa.array([t.encode() for t in texts]), np.array(lo), 50, [40, 50])
    strings = [t[p : p + 50] for t in texts for p in range(len(t) - 49)]
    assert got.tolist() == [min(d for u, d in zip(texts, lo) if x in u) for x in strings]
    assert max(longest, default=0) < sum(len(t) for t in texts) / 2


def test_contexts_meet_in_one_order():
    texts = ["the water is cold over there", "a water is cold over here", "the water is cold over there again", "unlike all"]
    least = suffix_dedup.order_contexts(np.array([1, 1, 1, 2]), pa.array([t.encode() for t in texts]), np.array([5, 3, 1, 9]), 10)
    for t, own in zip(texts[:3], least):
        assert own.tolist() == [min(d for u, d in zip(texts[:3], (5, 3, 1)) if t[p : p + 10] in u) for p in range(len(t) - 9)]
