"""The metric index: exact results, and meetings that grow slower than with the square of the rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilseries.functions.columns import INSTANCE
from vigilseries.operators import neighbours
from vigilseries.operators.neighbours import Search


def clustered(n, seed=0, clusters=40, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.random((clusters, dim)) * 10
    return centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, dim))


def frame(spark, vectors, name="rid", instance="i", aux=None):
    rows = [
        ("a", instance, i, [float(x) for x in v], None if aux is None or aux[i] is None else float(aux[i]))
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, f"application string, instance string, {name} long, vec array<double>, aux double")


def distances(q, r):
    return np.sqrt(neighbours.squared_distances(np.asarray(q), np.asarray(r)))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "PART", 100)
    monkeypatch.setattr(neighbours, "BOUNDED", 8)


def meetings(spark, n):
    q, r = clustered(n, 1), clustered(n, 2)
    rows = neighbours.blocks(
        frame(spark, q, "qid").drop("aux"), frame(spark, r), INSTANCE, Search(1, balls=True)
    )
    met = rows.groupBy("cell", "qb", "rb").agg(F.count_if("is_query").alias("q"), F.count_if(~F.col("is_query")).alias("r"))
    row = met.where("q > 0 and r > 0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q") * F.col("r")).alias("pairs")).first()
    return row.n, row.pairs


def test_meetings_grow_slower_than_the_square(spark):
    few, few_pairs = meetings(spark, 1000)
    many, many_pairs = meetings(spark, 4000)
    assert many < 8 * few  # all blocks meeting all others: 16 times
    assert many < (4000 / 32) ** 2 / 8
    assert few_pairs < 1000**2 / 8 and many_pairs < 4000**2 / 8


@pytest.mark.parametrize("shape", ["clusters", "uniform", "copies"])
def test_nearest_is_exact(spark, shape):
    rng = np.random.default_rng(5)
    make = {
        "clusters": lambda n, s: clustered(n, s),
        "uniform": lambda n, s: np.random.default_rng(s).random((n, 3)),
        "copies": lambda n, s: np.random.default_rng(s).integers(0, 2, (n, 2)) * 1.0,
    }[shape]
    q, r = make(300, 1), make(700, 2)
    radius = [None if k % 3 else rng.random() for k in range(700)]
    small = rng.random((5, q.shape[1]))
    qs = frame(spark, q, "qid").unionByName(frame(spark, small, "qid", "small")).drop("aux")
    refs = frame(spark, r, aux=radius).unionByName(frame(spark, small, instance="small"))
    found = neighbours.nearest(qs, refs)
    got = {x.qid: x for x in found.where("instance = 'i'").collect()}
    d = distances(q, r)
    plain = np.array([x is None for x in radius])
    balls = np.array([x or 0.0 for x in radius])
    assert sorted(got) == list(range(300))
    for i in range(300):
        assert got[i].near == d[i, plain].min()
        assert got[i].hit == bool((d[i, ~plain] < balls[~plain]).any())
    assert [x.near for x in found.where("instance = 'small'").orderBy("qid").collect()] == [0.0] * 5


def test_only_balls(spark):
    """Without plain references every query still has its row."""
    q, r = clustered(80, 1), clustered(200, 2)
    refs = frame(spark, r, aux=[0.1] * 200)
    found = neighbours.nearest(frame(spark, q, "qid").drop("aux"), refs).collect()
    d = distances(q, r)
    assert sorted(x.qid for x in found) == list(range(80)) and all(x.near is None for x in found)
    assert all(x.hit == bool((d[x.qid] < 0.1).any()) for x in found)


def test_without_itself(spark):
    v = clustered(400, 3)
    v[7] = v[8]
    rows = frame(spark, v)
    found = neighbours.nearest(rows.select(*INSTANCE, F.col("rid").alias("qid"), "vec"), rows, skip_same=True)
    d = distances(v, v)
    np.fill_diagonal(d, np.inf)
    assert {x.qid: x.near for x in found.collect()} == dict(enumerate(d.min(axis=1)))


@pytest.mark.parametrize("k", [1, 5, 300, 500])
def test_k_nearest_is_exact(spark, k):
    q, r = clustered(60, 1, clusters=5), clustered(400, 2, clusters=5)
    r[50:60] = r[3]
    found = neighbours.k_nearest(frame(spark, q, "qid").drop("aux"), frame(spark, r, aux=range(400)), k)
    d = distances(q, r)
    got = {}
    for x in found.orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append((x.rid, x.dist, x.aux))
    for i in range(60):
        order = np.lexsort((np.arange(400), d[i]))[:k]
        assert got[i] == [(j, d[i, j], float(j)) for j in order]


def test_queries_move_once_where_distances_tell_nothing_apart(spark):
    """A query that needs every cell is one row all the same; a reference is one per block of queries."""
    q, r = (np.random.default_rng(s).random((n, 24)) for s, n in ((1, 300), (2, 700)))
    qs, refs = frame(spark, q, "qid").drop("aux"), frame(spark, r, aux=range(700))
    rows = neighbours.blocks(qs, refs, INSTANCE, Search(5))
    n = rows.agg(F.count_if("is_query").alias("q"), F.count_if(~F.col("is_query")).alias("r")).first()
    blocks = rows.where("is_query").select("cell", "qb", "rb").distinct().count()
    assert n.q == 300 and n.r <= 700 * blocks
    d = distances(q, r)
    got = {(x.qid, x.rank): (x.rid, x.dist) for x in neighbours.k_nearest(qs, refs, 5).collect()}
    for i in range(300):
        order = np.argsort(d[i], kind="stable")[:5]
        assert [got[i, n] for n in range(1, 6)] == [(j, d[i, j]) for j in order]


def test_queries_of_one_pivot_are_several_blocks(spark, monkeypatch):
    """Very many equal queries are dealt to blocks of bounded size; rows with the same key are not mixed."""
    monkeypatch.setattr(neighbours, "MOST_QUERIES", 32)
    q, r = np.vstack([np.ones((500, 3)), clustered(40, 1, dim=3)]), clustered(200, 2, dim=3)
    qs = frame(spark, q, "qid").unionByName(frame(spark, q[490:], "qid", "j")).drop("aux")
    refs = frame(spark, r).unionByName(frame(spark, r[::2], instance="j"))
    sizes = neighbours.blocks(qs, refs, INSTANCE, Search(1)).where("is_query").groupBy(*INSTANCE, "qb").count().collect()
    assert sum(x["count"] for x in sizes) == 590 and max(x["count"] for x in sizes) <= 3 * 32
    found = {(x.instance, x.qid): x.near for x in neighbours.nearest(qs, refs).collect()}
    assert all(found["i", n] == x for n, x in enumerate(distances(q, r).min(axis=1)))
    assert all(found["j", n] == x for n, x in enumerate(distances(q[490:], r[::2]).min(axis=1)))


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e200])
def test_matrix_product_decides_nothing_by_its_rounding(spark, shift):
    """Far from the origin the product is inexact: distances are still those of the differences."""
    q, r = (np.random.default_rng(s).integers(0, 3, (150, 4)) + shift for s in (1, 2))
    q, r = q * (1 + (shift > 1e100) * np.random.default_rng(3).random((150, 1))), r + 0.0
    qs, refs = frame(spark, q, "qid").drop("aux"), frame(spark, r, aux=range(150))
    with np.errstate(over="ignore", invalid="ignore"):
        d = distances(q, r)
    got = {(x.qid, x.rank): (x.rid, x.dist) for x in neighbours.k_nearest(qs, refs, 3).collect()}
    for i in range(150):
        order = [j for j in np.lexsort((np.arange(150), d[i])) if np.isfinite(d[i, j])][:3]
        assert [got[i, n + 1] for n in range(len(order))] == [(j, d[i, j]) for j in order]


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_few_pairs_are_measured_wherever_the_vectors_lie(shift, monkeypatch):
    """The product is taken around the middle of the queries, so its rounding does not grow with their values."""
    measured, measure = [], neighbours._pair_distances
    monkeypatch.setattr(neighbours, "_pair_distances", lambda q, r, i, j: measured.append(len(i)) or measure(q, r, i, j))
    lists = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
    q, r = (np.random.default_rng(s).random((200, 8)) + shift for s in (1, 2))
    d = distances(q, r)
    block = neighbours._Block(Search(3))
    marks = pa.array([[-1] * neighbours.WORDS] * 200, pa.list_(pa.int64()))
    block.parts.append(pa.table({"qid": range(200), "vec": lists(q), "within": np.sort(d, axis=1)[:, 2], "needs": marks}))
    block.meet(pa.table({"at": [0] * 200, "vec": lists(r), "rid": range(200), "aux": np.zeros(200)}))
    assert sum(measured) < 4 * 200
    assert (block.rid == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
    assert (np.sqrt(block.d2) == np.sort(d, axis=1)[:, :3]).all()
