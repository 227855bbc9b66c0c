import math

import numpy as np
import pytest

from vigilseries.llm import ann
from vigilseries.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, ids int, norm double, `bucket` string")


def wide(i, v):
    return (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "v", 2, 0.5, "b")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def smallest(rows):
    out = {}
    for i, v in rows:
        if i is not None and usable(v):
            v = np.float32(v).tolist()
            out[i] = min(v, out.get(i, v))
    return out


def brute(rows, asked, k=20):
    known, out = smallest(rows), {}
    for q, v in smallest(asked).items():
        near = []
        for i, w in known.items():
            if i != q:
                score = 0.0
                for a, b in zip(v, w, strict=True):
                    score += a * b
                near.append((-score, i))
        out[q] = sorted(near)[:k]
    return out


def by_query(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(n, dim, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_edges(spark):
    x = vectors(40, 5)
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(40, None), (41, [0.0] * 5), (42, [1.0, None, 0, 0, 0]), (43, [math.nan] * 5), (44, [math.inf, 0, 0, 0, 0])]
    rows += [(45, []), (None, x[0]), (60, x[0]), (60, x[0]), (60, x[1]), (80, 30 * x[2]), (-20, x[3] / 40), (46, [-0.0, 0, 0, 0, 0])]
    rows += [(i, v) for i, v in rows if i == 5]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    other = [(100, [1.0, 2.0]), (101, [1.0] * 7)]  # other lengths
    got = ann.nearest(frame(spark, [wide(*r) for r in rows + other]), frame(spark, [wide(*r) for r in asked + other]))
    assert by_query(got) == brute(rows, asked)


def test_fewer_candidates_than_wanted(spark):
    rows = [(20 * i, v) for i, v in enumerate(vectors(4, 3))]
    table = frame(spark, [wide(*r) for r in rows])
    assert by_query(ann.nearest(table, table)) == brute(rows, rows)


def test_empty(spark):
    none = frame(spark, [])
    assert ann.nearest(none, none).collect() == []
    some = frame(spark, [wide(1, [1.0, 2.0])])
    assert ann.nearest(some, some).collect() == [] and ann.nearest(some, none).collect() == []


@pytest.mark.parametrize("case", ["copies", "norms", "clusters"])
def test_many_buckets(spark, case, monkeypatch):
    """Results are nearly those of brute force; what is found has its exact score and place."""
    monkeypatch.setattr(ann, "BLOCK", 64)  # large buckets meet in blocks
    x = vectors(3000, 24, 1)
    if case == "copies":
        x[1000:2000] = x[7]
        x[2000:2500] = x[8] + 0.001 * vectors(500, 24, 2)
    if case == "norms":
        x *= np.exp(np.random.default_rng(3).normal(size=(len(x), 1)) * 2)
    if case == "clusters":
        x = x[np.arange(3000) % 50] + 0.3 * x
    rows = list(enumerate(x))
    table = frame(spark, [wide(*r) for r in rows])
    got = by_query(ann.nearest(table, table.where("vec_id % 20 = 0")))
    wanted = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == wanted.keys() and all(len(got[q]) == 20 for q in got)
    exact = np.float32(x).astype(float)
    for q, near in got.items():
        assert near == sorted(near)
        for score, i in near:
            assert -score == ann.inner(exact[q : q + 1], exact[i : i + 1])[0]
    hits = sum(len(set(got[q]) & set(wanted[q])) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, scale):
    folder = f"/root/testdata/{scale}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = by_query(QUERIES["op13_nearest_vectors"](spark, folder))
    hits = 0
    asked = np.flatnonzero(ids % 20 == 0)
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(ids[np.argsort(-score)[:20]]) & {i for _, i in got[ids[q]]})
    assert len(got) == len(asked) and hits >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("n", [500, 3000, 10_000_000])
def test_index(n):
    index = ann.Index(24, n, ((0, 1.0),))
    x = vectors(50, 24)
    codes = index.codes(x, np.ones(50) * 0.999)
    assert codes.min() >= 0 and codes.max() < index.buckets and index.buckets <= ann.MOST_BUCKETS
    for t in range(index.tables):
        first = index.probed(x, t, 1)[:, 0]
        assert (first == codes[:, t]).mean() > 0.8  # a vector's own bucket suits it best
        some = index.probed(x, t, max(index.buckets // 2, 1))
        assert all(len(set(r)) == len(r) for r in some)


def test_rotation_keeps_lengths():
    x = vectors(9, 16)
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), 1) and np.allclose(ann.hadamard(ann.hadamard(x)), x)
