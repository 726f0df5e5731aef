"""Nearest and near vectors by pivots, against all pairs."""

import duckdb
import numpy as np
import pytest
from ledgermill import queries
from ledgermill.operators import retrieval, vectors
from ledgermill.operators.vectors import Index


def cosines(a, b):
    norms = np.sqrt((a * a).sum(1)) + 1e-9, np.sqrt((b * b).sum(1)) + 1e-9
    return a @ b.T / norms[0][:, None] / norms[1][None, :]


def clusters(rng, n, size=12):
    centres = rng.normal(size=(6, size))
    rows = centres[rng.integers(0, 6, n)] + rng.normal(scale=0.4, size=(n, size))
    rows[: max(1, n // 20)] *= 10.0 ** rng.integers(-14, 3, (max(1, n // 20), 1))  # from next to nothing to large
    rows[n // 2] = 0
    return rows


@pytest.mark.parametrize(("n", "m", "pivots"), [(200, 60, 64), (150, 1, 64), (120, 300, 2), (80, 40, 1)])
def test_pivots_like_all_pairs(spark, monkeypatch, n, m, pivots):
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    rng = np.random.default_rng(n)
    q, r = clusters(rng, n), clusters(rng, m)
    r[m // 3] = q[7]
    names = rng.integers(0, max(1, m // 2), m)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(10_000, None)], "id long, vector array<double>")
    index = Index(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(names, r)] + [(5, None)], "name int, vector array<double>"))
    score = cosines(q, r)
    got = {x["id"]: (x["name"], x["score"]) for x in index.nearest(asked, 9).collect()}
    for i in range(n):
        rounded = np.round(score[i], 9)
        assert abs(got[i][1] - rounded.max()) <= 2e-9 and got[i][0] in names[rounded >= rounded.max() - 2e-9]
    assert len(got) == n
    for least in (0.9, 0.3):
        near = {(x["id"], x["name"]): x["score"] for x in index.within(asked, least).collect()}
        best = {(i, int(k)): score[i][names == k].max() for i in range(n) for k in set(names.tolist())}
        assert set(near) == {p for p, s in best.items() if s >= least} and all(abs(near[p] - best[p]) < 1e-9 for p in near)


def test_few_cells_are_met(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    r, q = (centres[np.arange(400) % 10] + rng.normal(scale=0.05, size=(400, 16)) for _ in range(2))
    rows = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} int, vector array<double>")
    assert Index(rows(r, "name"))._meet(rows(q, "id"), None).count() < 400 * 400 / 4


def test_labels_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    anchors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "label int, anchor array<double>")
    some = spark.createDataFrame([(4, [2.0, 0.0]), (5, [0.0, 0.0])], none.schema)
    assert retrieval.nearest_label(none, anchors).count() == 0 and retrieval.nearest_label(some, anchors.limit(0)).count() == 0
    assert {r["id"]: (r["label"], round(r["score"], 6)) for r in retrieval.nearest_label(some, anchors).collect()} == {4: (1, 1.0), 5: (1, 0.0)}


def test_rounded_ties_lie_in_other_cells(spark):
    rng = np.random.default_rng(8)
    turn = lambda n: (lambda x: np.stack([np.cos(x), np.sin(x)], 1))(rng.uniform(0, 6.2, n))
    q, r = turn(150), turn(400)
    rows = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} int, vector array<double>")
    got = {x["id"]: x["name"] for x in Index(rows(r, "name")).nearest(rows(q, "id"), 1).collect()}
    assert got == dict(enumerate(np.round(cosines(q, r), 1).argmax(1).tolist()))


NAN = float("nan")
BASE = [(0, [1.0, 0.0], 3), (1, [0.0, 1.0], 2), (2, [1.0, 1.0], 4)]
LABELLED = {
    "near ties": [(i, [1.0, 0.0, 1e-4 * i], 9 - i) for i in range(8)] + [(100 + i, [1.0, 1e-4 * i, 2e-4 * i], 1) for i in range(60)],
    "scaled": [(i, [2.0**i * x for x in ((1, 2, 3), (3, 1, 2), (1, 1, 1))[i % 3]], i % 7) for i in range(-60, 60)],
    "no direction": [*BASE, (30, None, 1), (31, [0.0, 0.0], 1), (32, [NAN, 1.0], 1), (33, [float("inf"), 1.0], 1), (None, [0.1, 1.0], 1)],
    "anchors without direction": [*BASE, (3, [0.0, 0.0], 9), (4, None, 4), (30, None, 1), (31, [2.0, 1.0], 1)],
    "labels without vectors": [*BASE, (3, None, 8), (4, None, 7), (5, None, None), (6, [0.0, 0.0], 1), (30, None, 1), (31, [NAN, 1.0], 1)],
    "no vectors": [(0, None, 3), (1, None, 2), (30, None, 5), (31, [1.0, 2.0], 5)],
    "anchors without labels": [(i, [1.0, 0.01 * i], None) for i in range(15)] + [(15, [-1.0, 0.2], 4), (16, [-1.0, 0.3], 2), (17, [0.0, -1.0], 5)] + [(i, [1.0, 0.013 * i], 1) for i in range(30, 40)],
}


@pytest.mark.parametrize("case", LABELLED)
def test_labels_like_sql(spark, tmp_path, case):
    spark.createDataFrame(LABELLED[case], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLES["embedding_nearest_label"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.QUERIES["embedding_nearest_label"](spark, str(tmp_path)).collect()), key=str) == want
