"""Embedding links against brute force over all pairs."""

import math

import numpy as np

from lodging.llm import embed_dedup as E
from lodging.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(rows, threshold=0.93):
    def ok(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if ok(v, a) and ok(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [e for k, (e, _, _) in enumerate(rows) if find(k) == find(i) and e is not None]
        c = min(ids) if ids else None
        out.append((d, n[i], c, d is not None and d == c))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n=240, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centers[r.integers(12)] + r.normal(size=dim) * r.choice([0.0, 0.05, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2))))
    return rows


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [float("inf")] + [1.0] * 7, 1),
    (905, [None] + [1.0] * 7, 1), (906, [1.0] * 8, None), (907, [1.0] * 8, 1), (908, [2.0] * 8, 1), (908, [2.0] * 8, 1),
    (None, [3.0] * 8, 1), (None, [0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (909, [1.0] * 7, 1), (910, [1e-30] * 8, 1), (911, [1e30] * 8, 1),
]


def test_all_settings_give_the_brute_force_result(spark):
    rows = clustered() + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows])
    for kw in ({}, {"cell": 10, "block": 15, "block_bytes": 0}, {"cell": 1, "max_pivots": 7, "block": 1000, "block_bytes": 0}):
        assert result(E.near_duplicates(df, **kw)) == want, kw


def test_cells_miss_no_pair():
    r = np.random.default_rng(2)
    x = E._unit(np.concatenate([r.normal(size=(300, 4)), r.normal(size=(20, 4)).repeat(10, 0) + r.normal(size=(200, 4)) * 0.05]))
    eps = float(np.sqrt(2 - 2 * 0.93))
    row, cell, home = E.cells_of(x, x[::25], eps)
    assert len(row) < len(x) * len(x[::25])
    of = {}
    for a, c, h in zip(row, cell, home):
        of.setdefault(a, {})[c] = h
    for i in range(len(x)):
        for j in range(i):
            if np.linalg.norm(x[i] - x[j]) <= eps:
                meet = [c for c in of[i] if c in of[j] and (of[i][c] or of[j][c])]
                assert len(meet) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert result(E.near_duplicates(df)) == []


def test_op10_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert result(E.op10_embeddings(spark, SF)) == brute(rows)
