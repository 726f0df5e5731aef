import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from ledgermill.llm import language_id, language_model, mixing, quality_classifier, quality_rules

crc = lambda i: zlib.crc32(str(i).encode())


def test_language(docs, texts, empty):
    out = {r["doc_id"]: r for r in language_id.predict(docs).collect()}
    known = [(i, lang) for i, t, lang, _ in texts if lang and t and len(t.split()) > 20 and i < 150]
    assert sum(out[i]["lang_pred"] == lang for i, lang in known) >= 0.98 * len(known)
    assert all(out[i]["held_out"] == (crc(i) % 4 == 2) and 0 <= out[i]["score"] <= 1 for i in out)
    assert [out[i]["lang_pred"] for i in (150, 151, 152, 155)] == ["und"] * 4
    assert language_id.predict(empty).count() == 0
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in language_id.predict(nameless).select("lang_pred").collect()} == {"und"}


def test_code_switches(spark, docs):
    chain = language_id.learn(docs)
    d = spark.createDataFrame([(1, "the and water house with the stone " * 3 + "und der wasser nicht straße über haus " * 3)], "doc_id long, text string")
    spans = language_id.identify(d, chain, with_spans=True).first()["spans"]
    assert [s["lang"] for s in spans][0] == "en" and [s["lang"] for s in spans][-1] == "de" and sum(s["length"] for s in spans) == 42


def test_posteriors_of_blocks_equal_one_chain():
    chain = language_id.Chain(["a", "b", "c"])
    rng = np.random.default_rng(4)
    chain.transition = rng.normal(size=(3, 3)).astype(np.float32)
    sizes = [1, 0, 64, 65, 200, 3]
    emit = rng.uniform(0.05, 1, (sum(sizes), 3)).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got, a = chain.posteriors(emit, bounds), np.exp(chain.transition.astype(float))
    for s, e in zip(bounds, bounds[1:]):
        f, b = [], [np.ones(3)]
        v = np.full(3, 1 / 3)
        for t in range(s, e):
            v = (v @ a) * emit[t]
            v /= v.sum()
            f.append(v)
        for t in range(e - 1, s, -1):
            u = a @ (emit[t] * b[-1])
            b.append(u / u.sum())
        for t in range(s, e):
            p = f[t - s] * b[e - 1 - t]
            assert np.allclose(got[t], p / p.sum(), atol=1e-4)


def test_language_model(docs, texts, empty):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in texts]
    c = Counter(x for i, w in tokens if crc(i) % 10 for x in w)
    n, v = sum(c.values()), len(c)
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in language_model.score(docs).collect())
    assert got == sorted((i, crc(i) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens)
    scores = language_model.score(docs).agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert scores[0] > scores[1] and scores[2] < 0
    assert language_model.score(empty).count() == 0


def test_weights_by_expectation_maximisation():
    w = language_model.learn_weights([(3, 0, 40, 900), (3, -1, 40, 100)], 1000)
    assert w.shape == (language_model.BUCKETS, 3) and np.allclose(w.sum(1), 1) and w[3, 0] > 0.8 and w[0, 0] == 0


def test_quality(spark, docs, texts, empty):
    junk = [(1000 + i, f"buy$$$ {i} now### cheap$$$ win### " * 5, "en", "s0") for i in range(60)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, lang) for i, t, lang, _ in junk], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1) for i, *_ in texts if i < 100] + [(i, 0) for i, *_ in junk] + [(1, None), (99_999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_classifier.classify(both, labels).collect()}
    assert all(out[i]["predicted"] == 0 for i, *_ in junk) and sum(out[i]["predicted"] for i, *_ in texts if i < 120) >= 118
    assert all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in out.items())
    kept = quality_classifier.keep_good(both, labels)
    assert kept.columns == both.columns and kept.filter("doc_id >= 1000").count() == 0
    none = labels.limit(0)
    assert {r["predicted"] for r in quality_classifier.classify(docs, none).collect()} == {1}
    assert quality_classifier.classify(empty, labels).count() == 0


def model_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if seen[(w[k], w[k + 1], w[k + 2])] > 1:
            cover |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_rules(spark, docs, texts, empty):
    names = ["doc_id", *quality_rules.BASE, "base_failed"]
    out = quality_rules.judge(docs)
    assert sorted(tuple(r[c] for c in names) for r in out.collect()) == sorted((i, *model_counts(t)) for i, t, *_ in texts)
    assert quality_rules.judge(empty).count() == 0
    rng = np.random.default_rng(5)
    good = [(i, " ".join("w" * int(k) + str(j) for j, k in enumerate(rng.integers(2, 7, 80))), "en", "s") for i in range(200)]
    bad = [(500 + i, " ".join(f"a{j}$$$" for j in range(80)), "en", "s") for i in range(9)]
    few = [(600, good[0][1], None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad) and got[600]


def test_mixing(docs, texts, empty):
    used = mixing.mix(docs, 1.0, 0.9, 2.0).collect()
    words = Counter()
    for _, t, _, s in texts:
        words[s] += len((t or "").split())
    total, sums = sum(words.values()), Counter()
    for r in used:
        sums[r["source"]] += r["n_tokens"]
    weight = {r["source"]: r["weight"] for r in used}
    h = -sum(w * math.log(w) for w in weight.values() if w)
    longest = max(len((t or "").split()) for _, t, *_ in texts)
    for s, w in weight.items():
        assert sums[s] <= round(w * total) and (sums[s] > w * total - longest or sums[s] == 0)
        assert not words[s] or w * total <= 2.0 * words[s] + 1
    assert h > 0 and max(Counter((r["doc_id"], r["epoch"], r["source"]) for r in used if r["doc_id"] != 5).values()) == 1
    assert mixing.mix(empty).count() == 0
    once = mixing.sample_once(docs)
    assert once.columns == docs.columns and 0 < once.count() < docs.count()
    assert mixing.sample_once(docs, entropy=0.0).count() == docs.count()  # even enough: nothing goes
    # every source whole once the budget is everything and the exponent one
    assert mixing.mix(docs, 1.0, 0.0, 1.0).filter("epoch = 0").count() == docs.count()


def test_rows_without_ids(nameless):
    """Every operator returns each row, whatever its doc_id; equal texts get equal results."""
    rows, docs = nameless
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for out in (language_id.predict(docs), language_model.score(docs), quality_classifier.classify(docs, labels), quality_rules.judge(docs), mixing.mix(docs, 1.0, 0.0, 1.0).filter("epoch = 0")):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, *_ in rows)
    once = mixing.sample_once(docs, entropy=0.99, least=0.3)
    assert once.columns == docs.columns and 0 < once.count() <= docs.count()


def test_pipeline(spark, tmp_path, docs, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, *_ in texts if i < 100], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns and frame.count() <= before.count()
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in frame.select("doc_id").collect()}


def concentrated(x, floors, steps=60):
    """Least-determinant centre and scatter of the nearest 3/4 by numpy, from the operator's two starts."""
    best = None
    med = np.median(x, axis=0)
    mads = np.median(np.abs(x - med), axis=0)
    for m, c in ((med, np.diag((mads * 1.4826) ** 2)), (x.mean(0), np.cov(x.T, bias=True))):
        for _ in range(steps):
            d = x - m
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(c + np.diag(floors**2)), d)
            near = x[np.argsort(d2, kind="stable")[: math.ceil(quality_rules.KEEP * len(x))]]
            m, c = near.mean(0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY
        det = np.linalg.slogdet(c + np.diag(floors**2))[1]
        if best is None or det < best[0]:
            best = det, m, c + np.diag(floors**2)
    return best


def test_estimates_like_numpy(spark):
    rng = np.random.default_rng(8)
    groups = {}
    for g, (n, bad) in {"a": (900, 0), "b": (700, 150), "c": (400, 60)}.items():
        x = rng.normal(size=(n, 5)) @ np.triu(rng.uniform(0.2, 0.6, (5, 5))) + rng.normal(size=5)
        x[:bad] = x[:bad] * 0.1 + 6
        groups[g] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    good = spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} double" for n in quality_rules.NAMES))
    floors = np.array(list(quality_rules.STATISTICS.values()))
    for p in quality_rules.estimate(good).collect():
        det, m, c = concentrated(groups[p["g"]], floors)
        factor = np.array([[p[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([p[f"m{i}"] for i in range(5)], m, atol=0.12)
        assert abs(2 * np.log(np.diag(factor)).sum() - det) < 0.35  # buckets of distances keep a few rows more than 3/4
        assert np.allclose(factor @ factor.T, c, atol=0.15)


def test_scores_like_a_sequential_model(docs, texts):
    """op3 against dictionaries of counts and the same expectation-maximisation."""
    roles = {(r["doc_id"], r["text"]): r["d"] for r in docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.lit(language_model.SEED)), F.lit(language_model.DELETED)) == 0).alias("d")).collect()}
    rows = [(i, [*(t or "").encode().lower().split(), "END"], crc(i) % 10 == 0, roles[i, t]) for i, t, *_ in texts]
    parts = {side: (Counter(), Counter()) for side in (False, True)}
    for _, w, held, deleted in rows:
        if not held:
            parts[deleted][0].update(w)
            parts[deleted][1].update(zip(["START", *w], w))
    kept, kept2 = parts[False]
    bucket = lambda c: int(min(math.log2(c + 1), language_model.BUCKETS - 1))
    context = lambda c, h: c["END" if h == "START" else h]
    n = sum(kept.values())
    cells = Counter()
    for _, w, held, deleted in rows:
        if deleted and not held:
            for h, x in zip(["START", *w], w):
                c, pair = context(kept, h), kept2[h, x]
                cells[bucket(c), round(-4 * math.log2(pair / c)) if pair else -1, round(-4 * math.log2(kept[x] / n)) if kept[x] else -1] += 1
    weights = language_model.learn_weights([(*k, v) for k, v in cells.items()], len(kept))
    every, every2 = kept + parts[True][0], kept2 + parts[True][1]
    n, v = sum(every.values()), len(every)
    expected = []
    for i, w, *_ in rows:
        total = 0.0
        for h, x in zip(["START", *w], w):
            c = context(every, h)
            l2, l1, l0 = weights[bucket(c)]
            total += math.log10(l2 * every2[h, x] / max(c, 1) + l1 * every[x] / n + l0 / (v + 1))
        expected.append((i, total))
    got = sorted((r["doc_id"], r["score"]) for r in language_model.score(docs).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(expected)]
    assert np.allclose([s for _, s in got], [s for _, s in sorted(expected)], rtol=1e-6)


def test_ratios_and_descent_on_a_tiny_set():
    """op4: log-count ratios by definition; at the descent's end no coordinate of the dual can be improved."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.uint32) for _ in range(40)]
    y = np.where(np.array([5 in r for r in rows]) ^ (rng.random(40) < 0.1), 1.0, -1.0)
    model = quality_classifier.Model([], np.zeros(0))
    model.ratio = quality_classifier.Model._ratios(rows, y)
    size = 1 << quality_classifier.BITS
    counts = {side: np.ones(size) for side in (1.0, -1.0)}
    for r, side in zip(rows, y):
        counts[side][r] += 1
    assert np.allclose(model.ratio, np.log(counts[1.0] / counts[1.0].sum() / (counts[-1.0] / counts[-1.0].sum())), atol=1e-5)
    weight = model._descend(rows, y)
    cost = {1.0: 1.0, -1.0: max(1.0, (y > 0).sum() / (y < 0).sum())}
    x = np.zeros((40, 30))
    for k, r in enumerate(rows):
        x[k, r] = model._scaled(r)
    # the primal objective at the fit is close to the least that plain subgradient steps reach
    value = lambda w: w @ w / 2 + sum(cost[s] * max(0.0, 1 - s * float(row @ w)) for row, s in zip(x, y))
    w = np.zeros(30)
    best = value(w)
    for k in range(1, 6000):
        g = w - sum((cost[s] * s * row for row, s in zip(x, y) if s * float(row @ w) < 1), np.zeros(30))
        w = w - g / (k + 10)
        best = min(best, value(w))
    assert value(weight[:30].astype(float)) <= best * 1.03


def test_training_gradient_by_differences():
    """op1: one small AdaGrad step moves transitions by the sign of the likelihood's difference quotient."""
    rng = np.random.default_rng(2)
    chain = language_id.Chain(["a", "b"])
    w, y = rng.integers(0, 6, (3, language_id.LENGTH)), rng.integers(0, 2, (3, language_id.LENGTH))
    table, real = language_id.word_features(["ab", "abc", "b", "cab", "", "xyz"])
    member = rng.integers(0, 2, (6, 2)).astype(np.float32)
    for x in (chain.weight, chain.lexical, chain.transition):
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)

    start = np.log(np.exp(chain.transition.astype(float)).mean(0))  # from a uniform state before the first word; not learned

    def likelihood(transition):
        e = (chain.weight[table[w]] * real[w][..., None]).sum(2) + member[w] @ chain.lexical
        total = 0.0
        for r in range(3):
            v = e[r, 0] + start
            path = v[y[r, 0]]
            for t in range(1, language_id.LENGTH):
                v = np.logaddexp.reduce(v[:, None] + transition, axis=0) + e[r, t]
                path += transition[y[r, t - 1], y[r, t]] + e[r, t, y[r, t]]
            total += path - np.logaddexp.reduce(v)
        return total / 3

    before, step = chain.transition.astype(float).copy(), 1e-4
    slope = np.array([[(likelihood(before + step * np.eye(4)[2 * i + j].reshape(2, 2)) - likelihood(before - step * np.eye(4)[2 * i + j].reshape(2, 2))) / (2 * step) for j in range(2)] for i in range(2)])
    sums = [np.full_like(x, 1e8) for x in (chain.weight, chain.lexical, chain.transition)]  # steps proportional to the gradient
    old = chain.transition.copy()
    chain.transition = chain.transition.astype(np.float64)
    chain._batch(w, y, table, real.astype(np.float32), member, [s.astype(np.float64) for s in sums])
    moved = (chain.transition - old) / (language_id.RATE / 1e4)
    assert np.allclose(moved, slope, atol=2e-2)
