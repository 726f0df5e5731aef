"""Names in texts by minimizers, against a search of every name in every text."""

import random

import numpy as np
import pytest
from ledgermill.operators import containment, vendor


def expected(texts, names):
    return sorted(((i, n) for i, n in {(i, n) for i, t in texts for n, name in names if name and t and name in t}), key=str)


@pytest.mark.parametrize("tier", range(len(containment.tiers())))
def test_keys_of_a_name_are_among_those_of_its_texts(tier):
    rng = random.Random(tier)
    k, w = containment.tiers()[tier]
    draw = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    for _ in range(100):
        name = draw(k + w - 1 + (rng.randrange(20) if w > 1 else 0))
        text = draw(rng.randrange(30)) + name + draw(rng.randrange(30))
        keys = lambda s: set(containment.gram_keys(np.frombuffer(s.encode(), np.uint8), np.array([len(s)]), k, w)[1].tolist())
        assert keys(name) and keys(name) <= keys(text)
    parts = [draw(rng.randrange(40)) for _ in range(20)]
    ends = np.cumsum([len(p) for p in parts])
    at, h = containment.gram_keys(np.frombuffer("".join(parts).encode(), np.uint8), ends, k, w)
    for i, p in enumerate(parts):  # texts that follow each other don't mix
        assert set(h[np.searchsorted(ends, at, "right") == i].tolist()) == keys(p)


def test_occurrences_like_a_search(spark, monkeypatch):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcd12") for _ in range(n))
    texts = [(i, draw(rng.choice([0, 3, 50, 400]))) for i in range(150)] + [(None, draw(80)), (None, "q" * 50), (7, draw(60)), (901, None), (902, "")]
    names = [(n, draw(rng.randint(1, 9))) for n in range(150)] + [(1000 + n, rng.choice(texts)[1][: rng.randint(1, 60)]) for n in range(40) if rng.random() < 2 and texts[n][1]]
    names += [(2000 + n, t[a : a + rng.randint(8, 60)]) for n, (_, t) in enumerate(texts) if t and len(t) > 40 for a in (rng.randrange(len(t) - 20),)]
    names += [(3000, ""), (3001, None), (3002, "a"), (3003, "qqqqqqqqqqqqqqqqqqqqqqqqq"), (3004, names[0][1])]
    names = [(n, x) for n, x in names if x is None or x is not None]
    frames = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(names, "name_id long, name string").repartition(2)
    wanted = expected(texts, names)
    assert sorted((tuple(r) for r in containment.occurrences(*frames).collect()), key=str) == wanted and len(wanted) > 500
    monkeypatch.setattr(containment, "HEAVY", 5)  # nearly every key is dealt to salts
    assert sorted((tuple(r) for r in containment.occurrences(*frames).collect()), key=str) == wanted
    assert containment.occurrences(frames[0].limit(0), frames[1]).count() == 0 and containment.occurrences(frames[0], frames[1].limit(0)).count() == 0


def test_a_million_aliases_and_one_in_every_text(spark):
    aliases = spark.range(1_000_000).selectExpr("cast(id as string) vendor_key", "0 ord", "concat('Trading House No. ', id * 7919, ' Ltd') alias")
    vendors = spark.range(1_000_001).selectExpr("if(id = 1000000, 'all', cast(id as string)) vendor_key", "id ord")
    everywhere = spark.createDataFrame([("all", 0, "Statement of Account")], aliases.schema)
    docs = spark.range(2000).selectExpr("id doc_id", "concat('STATEMENT OF ACCOUNT for ', if(id % 10 = 0, concat('trading house no. ', id * 50 * 7919, ' ltd'), 'nobody'), ' page') text")
    found = vendor.match_aliases(docs, vendors, aliases.unionByName(everywhere))
    got = {r["doc_id"]: r["vendor_key"] for r in found.collect()}
    assert got == {i: str(i * 50) if i % 10 == 0 else "all" for i in range(2000)}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
