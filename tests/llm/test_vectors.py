import math

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import nearest, vector_groups


def vectors(n=700, dims=16, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, dims)).astype(np.float32)
    for i in range(0, n, 10):  # groups of near copies
        for j in range(1, 4):
            base[i + j] = base[i] + rnd.normal(size=dims).astype(np.float32) * 0.03
    return base


def rows(v):
    out = [(i, [float(x) for x in e], i % 3 if i % 17 else None) for i, e in enumerate(v)]
    out += [(9000, None, 1), (9001, [0.0] * v.shape[1], 1), (9002, [math.nan] * v.shape[1], 1), (9003, [math.inf] + [0.0] * (v.shape[1] - 1), 1), (9004, [None] + [1.0] * (v.shape[1] - 1), 1), (9050, [1.0, 2.0], 1), (9100, [2.0, 4.0], 1)]
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, dims string"


def test_nearest_recall(spark):
    v = vectors()
    data = [(*r, "x") for r in rows(v)]
    df = spark.createDataFrame([*data, data[3], (None, data[0][1], 0, "x")], SCHEMA)
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    hit = all_ = 0
    for q in range(0, len(v), 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        want = np.lexsort((np.arange(len(v)), -cosine))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine[i]) < 1e-12 for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & set(want.tolist()))
        all_ += 5
    assert hit >= 0.95 * all_
    assert {(r["query_id"], r["vec_id"]) for r in got if r["query_id"] >= 9000} == {(9050, 9100), (9100, 9050)}


def test_nearest_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0 if i < 60 else 1.0]) for i in range(0, 70)], "vec_id long, embedding array<float>")
    got = nearest.nearest_neighbours(df, F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]
    assert nearest.nearest_neighbours(df.where("false"), F.lit(True)).count() == 0
    assert nearest.nearest_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def plain_groups(data, least=0.98):
    ok = [i for i, (_, e, lab, *_) in enumerate(data) if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    parent, count = list(range(len(data))), [0] * len(data)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and data[a][2] == data[b][2] and len(data[a][1]) == len(data[b][1]):
                x, y = (np.array(np.array(data[k][1], np.float32), np.float64) for k in (a, b))
                if (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()) >= least:
                    count[a] += 1
                    count[b] += 1
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    ids = {}
    for i, r in enumerate(data):
        ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted((r[0], count[i], ids[find(i)]) for i, r in enumerate(data))


def test_groups(spark):
    data = rows(vectors(300))
    data += [(500 + i, data[20][1], data[20][2]) for i in range(4)] + [data[31]]
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    want = plain_groups(data)
    got = vector_groups.vector_groups(df)
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect())
    assert found == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    assert vector_groups.audit_recall(df, got, every=10) >= 0.99
    assert vector_groups.vector_groups(df.where("false")).count() == 0


def test_groups_in_small_cells(spark):
    data = rows(vectors(600, dims=32, seed=5))
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_groups.vector_groups(df, cell=64).collect())
    assert got == plain_groups(data)


def test_one_label_of_many_vectors_equals_brute_force(spark):
    """Six intrinsic dimensions, so that links cross the borders of cells, and a crowd that no cut makes smaller."""
    rnd = np.random.default_rng(9)
    v = rnd.normal(size=(6000, 6)) @ rnd.normal(size=(6, 24))
    v[:1500] = v[0] + rnd.normal(size=(1500, 24)) * 0.02
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in e], 1, "x") for i, e in enumerate(v)], SCHEMA)
    unit = v.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    while True:
        best = np.array([min(root[i], root[near[i]].min(initial=len(v))) for i in range(len(v))])
        if (best == root).all():
            break
        root = best
    got = vector_groups.vector_groups(df, cell=500).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == list(zip(range(len(v)), near.sum(axis=1).tolist(), root.tolist()))
