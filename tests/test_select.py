from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions import storage
from vigilseries.functions.quantiles import bracketed_quantiles, grouped_quantiles
from vigilseries.operators import forest, gates, select

CFG = DetectorConfig(freq=60)
SERIES = "application string, instance string, metric string, t long, value double"


def long(spark, instances):
    rows = [
        ("a", inst, m, 60 * t, float(v))
        for inst, metrics in instances.items()
        for m, vs in metrics.items()
        for t, v in enumerate(vs)
    ]
    order = [
        ("a", inst, m, i) for inst, metrics in instances.items() for i, m in enumerate(metrics)
    ]
    return spark.createDataFrame(rows, SERIES), spark.createDataFrame(
        order, "application string, instance string, metric string, ord int"
    )


def names(frame):
    return sorted(r["metric"] for r in frame.collect())


def test_variability_and_variance(spark):
    low, high = np.sqrt(0.0009), np.sqrt(0.0011)
    frame, order = long(
        spark, {"i": {"flat": [3, 3, 3, 3], "low": [-low, low] * 2, "high": [-high, high] * 2}}
    )
    stats = select.profile(frame, order)
    assert names(select.variable(stats)) == ["high", "low"]
    assert names(select.varying_enough(stats, CFG.variance_floor)) == ["high"]


def chain(rng, n=400):
    """1 and 2 as well as 2 and 3 correlate above 0.9, 1 and 3 do not."""
    x, y = rng.normal(size=n), rng.normal(size=n)
    turn = np.arccos(0.93)
    return {
        "m1": x,
        "m2": np.cos(turn) * x + np.sin(turn) * y,
        "m3": np.cos(2 * turn) * x + np.sin(2 * turn) * y,
        "free": rng.normal(size=n),
    }


@pytest.mark.parametrize("mode", ["one block", "small blocks", "chunks"])
def test_a_dropped_metric_still_drops_others(spark, monkeypatch, mode):
    rng = np.random.default_rng(5)
    series = chain(rng)
    series["neg"] = -series["m1"]
    cfg, steps = CFG, 400
    if mode == "small blocks":
        monkeypatch.setattr(select, "METRIC_BLOCK", 2)
    if mode == "chunks":
        cfg, steps = replace(CFG, chunk_steps=50), None
    frame, order = long(spark, {"i": series, "j": chain(np.random.default_rng(6))})
    stats = select.profile(frame, order)
    found = select.correlated(frame, stats, cfg, steps)
    got = {
        (r["instance"], r["metric"]): (r["blocker"], r["r"]) for r in found.collect()
    }
    assert {k: v[0] for k, v in got.items()} == {
        ("i", "m2"): "m1",
        ("i", "m3"): "m2",
        ("i", "neg"): "m1",
        ("j", "m2"): "m1",
        ("j", "m3"): "m2",
    }
    want = np.corrcoef(series["m1"], series["m2"])[0, 1]
    assert got["i", "m2"][1] == pytest.approx(want)
    assert got["i", "neg"][1] == pytest.approx(-1)
    kept = select.uncorrelated(stats, found)
    assert names(kept.where("instance = 'i'")) == ["free", "m1"]


def test_importance_prefers_what_follows_the_row_number(spark):
    rng = np.random.default_rng(7)
    n = 320
    frame, order = long(
        spark, {"i": {"noise": rng.normal(size=n), "trend": np.arange(n), "half": np.arange(n) // 160}}
    )
    stats = select.profile(frame, order)
    got = {r["metric"]: r["importance"] for r in select.importance(frame, stats, CFG, n).collect()}
    assert got["trend"] > got["half"] > got["noise"]
    assert sum(got.values()) == pytest.approx(1)
    same = select.importance(frame, stats, CFG, None)
    assert {r["metric"]: r["importance"] for r in same.collect()} == pytest.approx(got)


def test_top_n_order(spark):
    stats = spark.createDataFrame(
        [("a", "i", m, i, 0.0, 1.0) for i, m in enumerate("wxyz")]
        + [("a", "j", m, i, 0.0, 1.0) for i, m in enumerate("xy")],
        "application string, instance string, metric string, ord int, vmin double, vmax double",
    )
    scores = spark.createDataFrame(
        [("a", "i", "w", 0.1), ("a", "i", "x", 0.2), ("a", "i", "y", 0.5), ("a", "i", "z", 0.2)],
        "application string, instance string, metric string, importance double",
    )
    got = select.top_n(stats, scores, 3).orderBy("instance", "ord").collect()
    assert [(r["instance"], r["metric"], r["ord"]) for r in got] == [
        ("i", "y", 0), ("i", "x", 1), ("i", "z", 2), ("j", "x", 0), ("j", "y", 1),
    ]


def grow(x, y, weight, depth, least=1e-6):
    """What the splits of one tree explain, per column; the first column and cut of the best wins."""
    gains = np.zeros(x.shape[1])
    todo = [(np.flatnonzero(weight > 0), 0)]
    for rows, level in todo:
        if level == depth:
            continue
        c, s = weight[rows].sum(), (weight[rows] * y[rows]).sum()
        best = (least, None, None)
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                left = rows[x[rows, j] <= cut]
                c1, s1 = weight[left].sum(), (weight[left] * y[left]).sum()
                gain = s1 * s1 / c1 + (s - s1) * (s - s1) / (c - c1) - s * s / c
                if gain > best[0]:
                    best = (gain, j, cut)
        if best[1] is not None:
            gains[best[1]] += best[0]
            side = x[rows, best[1]] <= best[2]
            todo += [(rows[side], level + 1), (rows[~side], level + 1)]
    return gains


def shares(trees):
    total = sum(g / g.sum() for g in trees if g.sum() > 0)
    return total / total.sum()


def test_forest_equals_trees_grown_one_by_one(spark):
    cfg = replace(CFG, forest_trees=4, forest_depth=3, importance_bins=6)
    rng = np.random.default_rng(3)
    n = 90
    trend = np.arange(n) + rng.normal(size=n) * 20
    series = {"i": {"a": rng.normal(size=n), "b": trend, "c": np.arange(n) // 30}, "j": {"b": rng.normal(size=n), "d": -trend}}
    frame, order = long(spark, series)
    stats = select.profile(frame, order)
    got = {(r["instance"], r["metric"]): r["importance"] for r in forest.importance(frame, stats, cfg, n).collect()}
    drawn = spark.range(n).select([
        forest.times_drawn(cfg.seed, F.lit(k), F.col("id").cast("double")).alias(str(k)) for k in range(4)
    ]).toPandas().to_numpy().astype(float)
    for instance, of in series.items():
        names_ = sorted(of)
        x = np.array([(np.quantile(of[m], np.arange(1, 6) / 6)[:, None] < np.asarray(of[m])).sum(axis=0) for m in names_]).T
        wanted = shares([grow(x, np.arange(n) * 1.0, drawn[:, k], 3) for k in range(4)])
        for m, w in zip(names_, wanted, strict=True):
            assert got[instance, m] == pytest.approx(w, abs=1e-12)


def test_forest_keeps_what_a_full_forest_keeps(spark):
    """Twenty metrics follow the row number less and less; a forest of unbinned trees without a
    bound on their depth, grown here, agrees on eight of the first ten at least."""
    rng = np.random.default_rng(5)
    n = 240
    x = np.array([np.arange(n) % (n - 7 * k) + rng.normal(size=n) * 12 * (k + 1) for k in range(20)]).T
    frame, order = long(spark, {"i": {f"m{k:02d}": x[:, k] for k in range(20)}})
    stats = select.profile(frame, order)
    got = {r["metric"]: r["importance"] for r in forest.importance(frame, stats, CFG, n).collect()}
    trees = [grow(x, np.arange(n) * 1.0, np.bincount(rng.integers(0, n, n), minlength=n) * 1.0, 50) for _ in range(4)]
    full = shares(trees)
    first = {f"m{k:02d}" for k in np.argsort(-full)[:10]}
    assert len(first & set(sorted(got, key=got.get)[-10:])) >= 8
    kept = select.select_metrics(frame, order, replace(CFG, importance="forest", top_n=10), n)
    assert kept.count() <= 10


def test_forest_without_splits(spark):
    frame, order = long(spark, {"i": {"a": [1.0, 1.0, 1.0]}})
    got = forest.importance(frame, select.profile(frame, order), CFG, 3).collect()
    assert [r["importance"] for r in got] == [0.0]


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(size=3001), "b": np.repeat([1.0, 2.0], [14000, 10]), "c": [5.0]}
    values |= {f"n{n}": rng.normal(size=n).round(2) for n in (2, 3, 197, 9999, 10001, 23456)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = bracketed_quantiles(frame, ["k"], "v", probabilities, "q")
    for r in got.collect():
        assert r["q"] == pytest.approx(list(np.quantile(values[r["k"]], probabilities)))
    assert got.count() == len(values)
    plain = grouped_quantiles(frame.where("k <> 'd'"), ["k"], "v", probabilities, 50_000, "q")
    assert {r["k"]: tuple(r["q"]) for r in plain.collect()} == {
        r["k"]: pytest.approx(tuple(r["q"])) for r in got.collect()
    }


def test_outlier_fences(spark):
    import pandas as pd

    rng = np.random.default_rng(10)
    n = 200
    x, y = rng.normal(size=n), rng.normal(size=n)
    x[0], y[0], y[1] = 50, 3, -40
    frame = pd.DataFrame({"x": x, "y": y, "flat": np.ones(n)})
    frame.loc[5, "x"] = np.nan
    frame.loc[6, "flat"] = np.nan

    def expected(df, lower, upper):
        for column in df.columns:
            q1, q3 = df[column].quantile([0.1, 0.9])
            if q3 == q1:
                continue
            lo = max(q1 - 1.5 * (q3 - q1), lower.get(column, -np.inf))
            hi = min(q3 + 1.5 * (q3 - q1), upper.get(column, np.inf))
            df = df[(df[column] >= lo) & (df[column] <= hi)]
        return df.dropna()

    rows = [
        ("a", "i", t, *[None if np.isnan(v) else float(v) for v in r])
        for t, r in enumerate(frame.itertuples(index=False))
    ]
    wide = spark.createDataFrame(
        rows, "application string, instance string, t long, x double, y double, flat double"
    )
    for lower, upper in ({}, {}), ({"x": -1.0, "flat": 5.0}, {"y": 0.5}):
        want = list(expected(frame, lower, upper).index)
        for bound in (1000, None):
            got = gates.remove_outliers_iqr(
                wide, ["x", "y", "flat"], lower, upper, rows_per_key=bound
            )
            assert sorted(r["t"] for r in got.collect()) == want


def test_outlier_steps_of_a_mixed_fleet(spark):
    """By position on the long frame: the same steps as on each instance's own wide frame."""
    rng = np.random.default_rng(11)
    fleet = {
        "i": {"x": rng.normal(size=150), "y": rng.normal(size=150), "flat": np.ones(150)},
        "j": {"other": rng.standard_t(2, size=150)},
    }
    fleet["i"]["x"][3], fleet["i"]["y"][3], fleet["i"]["y"][7] = 90, 4, -90
    fleet["j"]["other"][9] = 1e4
    frame, order = long(spark, fleet)
    for steps in (150, None):
        got = gates.drop_outlier_steps(frame, order, steps=steps)
        for inst, metrics in fleet.items():
            wide = spark.createDataFrame(
                [("a", inst, 60 * t, *map(float, v)) for t, v in enumerate(zip(*metrics.values()))],
                "application string, instance string, t long, "
                + ", ".join(f"{m} double" for m in metrics),
            )
            want = gates.remove_outliers_iqr(wide, list(metrics), rows_per_key=150)
            steps_left = got.where(F.col("instance") == inst).select("t").distinct()
            assert {r["t"] for r in steps_left.collect()} == {r["t"] for r in want.collect()}
            assert 100 < want.count() < 150


def test_outliers_in_a_task_and_by_tables_are_the_same(spark, monkeypatch):
    """Ties, missing values, values that are no numbers, no spread, keys that are missing; sizes on
    both sides of the bound of a task and mixed. A thousand metrics take no table per metric."""
    rng = np.random.default_rng(5)
    rows = []
    for inst, n in (("big", 120), ("small", 30), (None, 6)):
        for t in range(n):
            x = [float(rng.integers(0, 9)) if t % 11 else 99.0, float(rng.standard_t(2)), 4.0]
            rows.append(("a", inst, t, x[0], None if t % 7 == 3 else x[1], float("nan") if t == 20 else x[2] + (t == 25)))
    wide = spark.createDataFrame(rows, "application string, instance string, t long, x double, y double, z double")
    kept = {}
    for cells in (10**6, 200, 10):  # all in tasks, one of each, none
        monkeypatch.setattr(gates, "CELLS_IN_TASK", cells)
        for bounds in ({}, {"lower": {"x": 1.0}, "upper": {"y": 1.5}}):
            for per_key in (None, 150):
                got = gates.remove_outliers_iqr(wide, ["x", "y", "z"], **bounds, rows_per_key=per_key).collect()
                kept.setdefault(str(bounds), []).append(sorted(str(tuple(r)) for r in got))
    for found in kept.values():
        assert all(f == found[0] for f in found) and 60 < len(found[0]) < 130

    fleet = {"big": {f"m{i:02}": rng.standard_t(2, size=90) for i in range(4)}, "small": {"m": rng.standard_t(2, size=90)}}
    frame, order = long(spark, fleet)
    want = None
    for cells in (10**6, 100, 10):
        monkeypatch.setattr(gates, "CELLS_IN_TASK", cells)
        got = sorted(map(tuple, gates.drop_outlier_steps(frame, order).select("instance", "metric", "t").collect()))
        assert want in (None, got) and 100 < len(got) < 5 * 90
        want = got

    monkeypatch.setattr(gates, "CELLS_IN_TASK", 10**6)
    monkeypatch.setattr(gates, "materialise", None)  # no table is written
    many = {"i": {f"m{i:04}": rng.normal(size=20) for i in range(1000)}}
    frame, order = long(spark, many)
    left = gates.drop_outlier_steps(frame, order, steps=20).select("metric", "t")
    assert left.count() == 1000 * left.select("t").distinct().count()


def test_stage_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda session: str(tmp_path))
    table = storage.materialise(spark.range(3), "numbers")
    assert table.count() == 3 and list((tmp_path / "stages").iterdir())
    storage.drop_stage_tables(spark)
    assert not list((tmp_path / "stages").iterdir())


def test_gates(spark):
    rows = [("a", "i", "m50", 1.0)] * 50 + [("a", "i", "m51", 1.0)] * 51 + [("a", "j", "m1", 1.0)]
    points = spark.createDataFrame(
        rows, "application string, instance string, metric string, value double"
    )
    enough = gates.enough_records(points, 50)
    assert [(r["metric"], r["records"]) for r in enough.collect()] == [("m51", 51)]
    assert gates.gate_points(points, 50).count() == 51
    expected = points.select("application", "instance", "metric").distinct()
    window = points.where("metric = 'm50'")
    assert names(gates.missing_metrics(expected, window)) == ["m1", "m51"]
    assert [r["instance"] for r in gates.instances_without_data(points.distinct(), enough).collect()] == ["j"]
    whole = gates.complete_instances(expected, points.where("metric <> 'm50'")).collect()
    assert [(r["instance"], r["n_selected"], r["n_present"]) for r in whole] == [("j", 1, 1)]
