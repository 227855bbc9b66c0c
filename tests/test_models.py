"""Negative selection and two clusters on small literals, against brute force in numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig, FeatureShape
from vigilseries.functions import quantiles
from vigilseries.operators import detect, kmeans, neighbours, nsa

CFG = DetectorConfig(freq=60)
POINT = "application string, instance string, rid long, label int, vec array<double>"


def points(spark, vectors, labels=None, instance="i", first=0):
    labels = [0] * len(vectors) if labels is None else labels
    rows = [
        ("a", instance, first + n, int(l), [float(x) for x in v])
        for n, (v, l) in enumerate(zip(vectors, labels, strict=True))
    ]
    return spark.createDataFrame(rows, POINT)


def queries(rows):
    return rows.select("application", "instance", F.col("rid").alias("qid"), "vec")


def brute(q, r):
    return np.sqrt(((np.asarray(q)[:, None, :] - np.asarray(r)[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("blocks", [None, 7])
def test_nearest_and_k_nearest(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neighbours, "BLOCK", blocks)
    rng = np.random.default_rng(0)
    q, r = rng.random((30, 3)), rng.random((41, 3))
    r[10] = r[3]
    r[20] = r[3]
    other = points(spark, rng.random((5, 3)), instance="alone")
    qf, rf = queries(points(spark, q).unionByName(other)), points(spark, r)
    refs = rf.withColumn("aux", F.lit(None).cast("double"))
    bound = None if blocks else 50
    got = neighbours.nearest(qf, refs, max_queries=bound, max_refs=bound)
    near = {x["qid"]: x["near"] for x in got.where("instance = 'i'").collect()}
    assert np.allclose([near[i] for i in range(30)], brute(q, r).min(axis=1))
    assert got.where("instance = 'alone'").count() == 0
    for k in (1, 4, 60):
        labelled = rf.withColumn("aux", F.col("label").cast("double"))
        found = neighbours.k_nearest(qf, labelled, k, max_queries=bound, max_refs=bound)
        rows = found.orderBy("qid", "rank").collect()
        d = brute(q, r)
        for i in range(30):
            order = np.lexsort((np.arange(41), d[i]))[:k]
            mine = [x for x in rows if x["qid"] == i]
            assert [x["rid"] for x in mine] == list(order)
            assert np.allclose([x["dist"] for x in mine], d[i][order])


def test_copies_do_not_change_neighbours(spark):
    rng = np.random.default_rng(1)
    r = np.vstack([np.repeat([[0.5, 0.5]], 40, axis=0), rng.random((10, 2))])
    labels = rng.integers(0, 2, 50)
    refs = points(spark, r, labels)
    q = queries(points(spark, rng.random((8, 2))))
    few = nsa.neighbours_of(q, refs, 5).orderBy("qid", "rank").select("qid", "rid", "aux").collect()
    assert neighbours.first_copies(refs, 5).count() <= 15
    plan = neighbours.first_copies(refs, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # copies are cut before and after the shuffle
    allof = neighbours.k_nearest(q, refs.withColumn("aux", F.col("label").cast("double")), 5)
    assert few == allof.orderBy("qid", "rank").select("qid", "rid", "aux").collect()


@pytest.mark.parametrize("blocks", [None, 5])
def test_threshold_is_the_percentile_of_second_nearest(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neighbours, "BLOCK", blocks)
    rng = np.random.default_rng(2)
    v = rng.random((40, 2))
    v[7] = v[8]
    d = np.sort(brute(v, v), axis=1)[:, 1]
    rows = points(spark, v).unionByName(points(spark, [[1, 1]], instance="single"))
    once = neighbours.distinct_points(rows)
    got = nsa.threshold(once, 95.0, None if blocks else 50).collect()
    assert [(r["instance"], r["threshold"]) for r in got] == [
        ("i", pytest.approx(np.percentile(d, 95)))
    ]


def test_threshold_searches_once(spark, monkeypatch):
    """However often a percentile reads the distances, the points meet in one of its stage tables."""
    searches, write = [], quantiles.materialise

    def noted(df, name):
        if "InArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            searches.append(name)
        return write(df, name)

    for module in (nsa, quantiles):
        monkeypatch.setattr(module, "materialise", noted)
    v = np.random.default_rng(8).random((60, 2))
    once = neighbours.distinct_points(points(spark, v))
    got = nsa.threshold(once, 95.0, None).first()["threshold"]
    assert got == pytest.approx(np.percentile(np.sort(brute(v, v), axis=1)[:, 1], 95))
    assert len(searches) == 1


@pytest.mark.parametrize("mode", ["corners", "centroids"])
def test_seed_tree_in_a_task_and_by_level(spark, mode):
    rng = np.random.default_rng(3)
    big, small = rng.random((170, 3)).round(2), rng.random((30, 3))
    rows = points(spark, big).unionByName(points(spark, small, instance="small"))
    one = nsa.seeds(rows, mode, 500)
    levels = nsa.seeds(rows, mode, None)
    key = ["instance", "cand"]
    a, b = one.orderBy(*key).collect(), levels.orderBy(*key).collect()
    assert [(r["instance"], r["cand"]) for r in a] == [(r["instance"], r["cand"]) for r in b]
    assert np.allclose([r["centre"] for r in a], [r["centre"] for r in b])
    root = next(r for r in a if r["instance"] == "i" and r["cand"] == 0)["centre"]
    assert np.allclose(root, big.min(axis=0) if mode == "corners" else big.mean(axis=0))
    assert sum(r["instance"] == "small" for r in a) == 1
    assert max(r["cand"] for r in a) == 2 ** nsa.tree_levels(170) - 2


def test_seed_tree_ends_in_a_task_where_nodes_fit(spark, monkeypatch):
    """Levels are shared out only until the nodes of an instance fit a task; the tree stays the same."""
    tables, rows = [], points(spark, np.random.default_rng(4).random((700, 3)).round(2))
    rows = rows.unionByName(points(spark, np.random.default_rng(5).random((90, 3)), instance="small"))
    write = nsa.materialise
    monkeypatch.setattr(nsa, "materialise", lambda df, name: tables.append(name) or write(df, name))
    found = [nsa.seeds(rows, "corners", None)]
    assert not [t for t in tables if t.startswith("tree-values")]
    for most, levels in ((200, 2), (100, 3), (10, 4)):
        tables.clear()
        monkeypatch.setattr(nsa, "TREE_ROWS", most)
        found.append(nsa.seeds(rows, "corners", None))
        assert sum(t.startswith("tree-values") for t in tables) == levels
    one, *others = [sorted((r.instance, r.cand, tuple(r.centre)) for r in f.collect()) for f in found]
    assert len(one) > 2 ** nsa.tree_levels(700) - 8 and all(other == one for other in others)


def model_of(spark, vectors, cfg=CFG, max_points=2000):
    rows = points(spark, vectors).withColumnRenamed("rid", "t")
    return nsa.train(rows, cfg, len(vectors[0]), max_points)


def test_training_properties(spark):
    rng = np.random.default_rng(4)
    v = rng.random((120, 4)) * 0.5
    model = model_of(spark, v)
    info = model.params.collect()[0]
    assert info["dim"] == 4 and info["self_radius"] == pytest.approx(0.1)
    balls = model.detectors.orderBy("det_id").collect()
    assert 0 < len(balls) <= CFG.max_detectors
    assert [b["det_id"] for b in balls] == list(range(len(balls)))
    away = brute([b["centre"] for b in balls], v).min(axis=1)
    assert np.allclose(away, [b["radius"] + info["self_radius"] for b in balls])
    assert all(b["radius"] > 0 for b in balls)
    own = points(spark, v).withColumnRenamed("rid", "t").select("application", "instance", "t", "vec")
    bits = nsa.score(own, model, CFG, max_queries=200, max_points=1000)
    assert bits.agg(F.sum("anomaly_bit"), F.max("distance_score")).first() == (0, 0.0)


def test_copies_make_the_threshold_zero_and_flag_everything(spark):
    model = model_of(spark, np.repeat([[0.2, 0.3]], 60, axis=0))
    own = points(spark, [[0.2, 0.3]]).withColumnRenamed("rid", "t")
    assert model.params.first()["threshold"] == 0
    assert nsa.score(own, model, CFG).first()["anomaly_bit"] == 1


def test_random_centres_are_shared_and_bounded(spark):
    known = spark.createDataFrame(
        [("a", "i", 2, 0.1), ("a", "j", 3, 0.2)],
        "application string, instance string, dim int, self_radius double",
    )
    got = nsa.random_centres(known, CFG, 3).collect()
    assert len(got) == 1000
    for r in got:
        edge = 0.1 if r["instance"] == "i" else 0.2
        assert len(r["centre"]) == (2 if r["instance"] == "i" else 3)
        assert all(-edge <= x <= 1 + edge for x in r["centre"])


def test_eleven_tests_per_candidate(spark):
    """Attempts 1..10 are tried after the first; the first that fits is taken."""
    once = points(spark, [[0.0, 0.0]])
    known = nsa.params(once, CFG.self_percentage)
    start = spark.createDataFrame(
        [("a", "i", c, [0.0, 0.0]) for c in range(200)],
        "application string, instance string, cand long, centre array<double>",
    )
    moved = nsa.perturbed(start, CFG, 2).orderBy("cand", "attempt").collect()
    assert len(moved) == 200 * CFG.max_attempts
    assert {r["attempt"] for r in moved} == set(range(1, 11))
    by = {(r["cand"], r["attempt"]): np.array(r["centre"]) for r in moved}
    for c in range(200):
        last = np.zeros(2)
        for a in range(1, 11):
            assert (np.abs(by[c, a] - last) <= CFG.self_percentage).all()
            last = by[c, a]
    radius = np.sqrt(2) * CFG.self_percentage
    want = {}
    for c in range(200):
        for a in range(1, 11):
            if np.linalg.norm(by[c, a]) > radius:
                want[c] = a
                break
    got = nsa.retry(start, once, known, CFG, 2)
    assert {r["cand"]: r["attempt"] for r in got.collect()} == want
    assert 0 < len(want)


def test_detector_cap_keeps_candidate_order(spark):
    found = spark.createDataFrame(
        [("a", "i", c, [0.0], 1.0) for c in (30, 5, 20)],
        "application string, instance string, cand long, centre array<double>, radius double",
    )
    got = nsa.cap_detectors(found.withColumn("radius", F.col("cand").cast("double")), 2)
    assert [(r["det_id"], r["radius"]) for r in got.orderBy("det_id").collect()] == [(0, 5.0), (1, 20.0)]


def test_outer_bound(spark):
    rows = points(spark, [[1.05, 1.05], [1.2, 1.2], [0.0, 1.6]])
    radius = F.lit(0.1)
    got = rows.select(nsa.outside(F.col("vec"), F.lit(2), radius).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True, True]


def test_vote(spark):
    known = spark.createDataFrame(
        [("a", "i", 2, 0.1)], "application string, instance string, dim int, self_radius double"
    )

    def voted(dists, labels, k=None):
        rows = [
            ("a", "i", 1, n, float(l), float(d), n + 1)
            for n, (d, l) in enumerate(zip(dists, labels, strict=True))
        ]
        frame = spark.createDataFrame(
            rows,
            "application string, instance string, qid long, rid long, aux double, dist double, rank int",
        )
        return nsa.vote(frame, known, k or len(dists)).first()["vote"]

    assert voted([0.05, 0.2, 0.3], [0, 1, 1]) is False  # trusted nearest
    assert voted([0.1, 0.2, 0.3], [0, 1, 1]) is False  # on the radius counts as within
    assert voted([0.11, 0.2, 0.3], [0, 1, 1]) is True  # too far: majority
    assert voted([0.05, 0.05, 0.05], [0, 1, 1]) is True  # equal distances: majority
    assert voted([0.2, 0.3], [0, 1]) is True  # a tie is anomalous
    assert voted([0.2, 0.3, 0.4], [1, 0, 0]) is False
    assert voted([0.2, 0.3], [1, 1], k=3) is None  # too few labelled points


def test_prediction_combines_the_rules(spark):
    rng = np.random.default_rng(5)
    normal = rng.random((60, 2)) * 0.2
    labels = [0] * 60 + [1] * 20
    labelled = points(spark, np.vstack([normal, [0.5, 0.5] + rng.random((20, 2)) * 0.05]), labels)
    model = model_of(spark, normal)
    asked = points(spark, [normal[0], [0.52, 0.52], [5, 5]])
    got = nsa.predict(queries(asked), model, labelled, 5).orderBy("qid").collect()
    assert [r["anomalous"] for r in got] == [False, True, True]


def test_tuning_prediction_meets_detectors_only(spark, monkeypatch):
    """No normal point is a reference; queries of a model without detectors have their row."""
    rows = points(spark, np.random.default_rng(9).random((90, 2)))
    rows = rows.unionByName(points(spark, [[0.2, 0.2], [0.4, 0.2]], instance="bare"))
    model = nsa.train(rows.withColumnRenamed("rid", "t"), replace(CFG, max_detectors=30), 2)
    model = replace(model, detectors=model.detectors.where("instance = 'i'"))
    refs, search = [], nsa.nearest
    monkeypatch.setattr(nsa, "nearest", lambda q, r, **more: refs.append(r) or search(q, r, **more))
    asked = np.random.default_rng(10).random((40, 2)) * 3 - 1
    both = points(spark, asked).unionByName(points(spark, asked, instance="bare"))
    got = {(x["instance"], x["qid"]): x["anomalous"] for x in nsa.tuning_prediction(queries(both), model).collect()}
    assert refs[0].where("aux is null").count() == 0
    balls = model.detectors.collect()
    inside = (brute(asked, [b["centre"] for b in balls]) < [b["radius"] for b in balls]).any(axis=1)
    far = np.sqrt((asked**2).sum(axis=1)) > np.sqrt(2) * (1 + np.sqrt(2) * CFG.self_percentage)
    assert inside.any() and far.any() and not (inside | far).all()
    assert [got["i", n] for n in range(40)] == list(inside | far)
    assert [got["bare", n] for n in range(40)] == list(far)


def test_tuning(spark):
    known = spark.createDataFrame(
        [("a", "i", 2, 0.1, 0.1)],
        "application string, instance string, dim int, self_radius double, threshold double",
    )
    balls = spark.createDataFrame(
        [("a", "i", 0, [0.5, 0.5], 0.2), ("a", "i", 1, [0.9, 0.9], 0.2)],
        "application string, instance string, det_id int, centre array<double>, radius double",
    )
    train = points(spark, [[0.0, 0.0]])
    model = nsa.NsaModel(known, neighbours.distinct_points(train), balls)
    sample = points(
        spark,
        [[0.55, 0.5], [0.75, 0.9], [0.3, 0.0], [0.05, 0.0], [0.9, 0.9]],
        [0, 0, 1, 1, 1],
    )
    got = nsa.tune(model, train, sample).collect()
    kept = [r["det_id"] for r in got if r["det_id"] is not None]
    added = [(r["centre"], r["radius"]) for r in got if r["det_id"] is None]
    assert kept == [1]  # ball 0 is within the self radius of a false alarm, ball 1 is not
    assert added == [([0.3, 0.0], pytest.approx(0.2))]  # too near to a training point otherwise


# --- two clusters -----------------------------------------------------------------------------

SHAPE = FeatureShape(lags=1)
KCFG = replace(CFG, kmeans_shape=SHAPE)


def feature_rows(spark, series):
    rows = [
        ("a", "i", m, 60 * t, *map(float, v)) for m, vs in series.items() for t, v in enumerate(vs)
    ]
    return spark.createDataFrame(
        rows, "application string, instance string, metric string, t long, l0 double, l1 double"
    )


def test_task_and_distributed_fits_agree(spark):
    rng = np.random.default_rng(6)
    series = {
        "two": np.vstack([rng.normal(0, 0.1, (60, 2)), rng.normal(3, 0.1, (20, 2))]),
        "wide": rng.random((70, 2)),
        "same": np.ones((10, 2)),
    }
    rows = feature_rows(spark, series)
    a = {r["metric"]: (r["c0"], r["c1"]) for r in kmeans.fit(rows, KCFG, 100).collect()}
    b = {r["metric"]: (r["c0"], r["c1"]) for r in kmeans.fit(rows, KCFG, None).collect()}
    for m in series:
        assert np.allclose(a[m], b[m])
    assert np.allclose(a["two"], [series["two"][:60].mean(axis=0), series["two"][60:].mean(axis=0)])
    assert a["same"] == ([1, 1], [1, 1])


def test_model_and_score_rules(spark):
    rng = np.random.default_rng(7)
    series = {"m": rng.random((80, 2)), "same": np.ones((10, 2))}
    rows = feature_rows(spark, series)
    models = {r["metric"]: r for r in kmeans.train(rows, KCFG, 100).collect()}
    x, m = series["m"], models["m"]
    raw = brute(x, [m["c0"], m["c1"]]).sum(axis=1)
    assert m["raw_min"] == pytest.approx(raw.min()) and m["raw_max"] == pytest.approx(raw.max())
    norm = (raw - raw.min()) / (raw.max() - raw.min())
    assert m["threshold"] == pytest.approx(np.percentile(norm, 95))
    assert (models["same"]["threshold"], models["same"]["raw_max"]) == (1.0, 0.0)
    scored = kmeans.score(rows, kmeans.train(rows, KCFG, 100), KCFG)
    rate = detect.kmeans_window_rate(scored, KCFG).where("metric = 'm'").first()["rate"]
    assert rate == pytest.approx(5, abs=2)
    same = scored.where("metric = 'same'").agg(F.max("anomaly_score"), F.max("anomaly_bit")).first()
    assert tuple(same) == (0.0, 0)
    unbounded = {r["metric"]: r["threshold"] for r in kmeans.train(rows, KCFG, None).collect()}
    assert unbounded == pytest.approx({k: r["threshold"] for k, r in models.items()})


def test_fixed_threshold_only_without_an_adaptive_one(spark):
    rows = feature_rows(spark, {"m": [[0, 0], [1, 1]]})
    models = spark.createDataFrame(
        [("a", "i", "m", [0.0, 0.0], [0.0, 0.0], 0.0, 10.0, None)],
        "application string, instance string, metric string, c0 array<double>, c1 array<double>, "
        "raw_min double, raw_max double, threshold double",
    )
    got = kmeans.score(rows, models, KCFG).orderBy("t").collect()
    assert [r["anomaly_bit"] for r in got] == [0, 1]
    assert got[1]["anomaly_score"] == pytest.approx(2 * np.sqrt(2) / 10)
