from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from vigilseries.config import DetectorConfig, FeatureShape
from vigilseries.operators import features

CFG = DetectorConfig(freq=60)


def frame(spark, values):
    rows = [("a", "i", m, 60 * t, float(v)) for m, vs in values.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(
        rows, "application string, instance string, metric string, t long, value double"
    )


def by_pandas(values, s: FeatureShape):
    x = pd.Series(values, dtype=float)
    if s.diffs >= 1:
        x = x.diff(s.diffs).dropna()
    if s.smooth >= 2:
        x = x.rolling(s.smooth).mean().dropna()
    wide = pd.concat([x.shift(n) for n in range(s.width)], axis=1).dropna().abs()
    return wide


SHAPES = [
    FeatureShape(),
    FeatureShape(lags=2, diffs=2, smooth=3),
    FeatureShape(lags=0, diffs=1, smooth=0),
    FeatureShape(lags=0, diffs=0, smooth=4),
    FeatureShape(lags=3, diffs=0, smooth=0),
    FeatureShape(lags=1, diffs=3, smooth=5),
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("chunk", [None, 12])
def test_equals_pandas(spark, shape, chunk):
    rng = np.random.default_rng(1)
    values = {m: rng.random(50).round(3) for m in "ab"}
    cfg, steps = (CFG, 60) if chunk is None else (replace(CFG, chunk_steps=chunk), None)
    got = features.featurise(frame(spark, values), shape, cfg, steps=steps)
    columns = features.lag_columns(shape)
    for metric, series in values.items():
        rows = got.where(got.metric == metric).orderBy("t").toPandas()
        want = by_pandas(series, shape)
        assert list(rows["t"] // 60) == list(want.index)
        assert np.allclose(rows[columns].to_numpy(), want.to_numpy())


def test_lost_and_unscored_rows(spark):
    shape = FeatureShape(lags=3, diffs=1, smooth=3)
    assert shape.lost_rows == 6 and shape.warmup_rows == 11
    rows = frame(spark, {"m": range(30)})
    assert features.featurise(rows, shape, CFG, steps=30).count() == 24
    for cfg, steps in ((CFG, 30), (replace(CFG, chunk_steps=13), None)):
        scored = features.featurise(rows, shape, cfg, steps=steps, scoring=True)
        assert sorted(r["t"] // 60 for r in scored.collect()) == list(range(11, 30))


def test_a_constant_offset_changes_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.random(40)
    a = features.featurise(frame(spark, {"m": x}), FeatureShape(), CFG, steps=40).toPandas()
    b = features.featurise(frame(spark, {"m": x + 100}), FeatureShape(), CFG, steps=40).toPandas()
    assert np.allclose(a[["l0", "l3"]], b[["l0", "l3"]])


def test_one_sort_per_series(spark):
    got = features.featurise(frame(spark, {"m": range(30)}), FeatureShape(), CFG, steps=30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("+- Exchange hashpartitioning") == 1


def test_names_in_text_order():
    names = features.feature_names(["b", "a"], FeatureShape(lags=10))
    assert names[:4] == ["a_lag0", "a_lag1", "a_lag10", "a_lag2"]
    assert features.feature_names(["b", "a"], FeatureShape(lags=0)) == ["a", "b"]


def test_scaling_projects_and_does_not_clip(spark):
    selected = spark.createDataFrame(
        [("a", "i", "m", 0, 10.0, 20.0)],
        "application string, instance string, metric string, ord int, vmin double, vmax double",
    )
    got = features.minmax_transform(frame(spark, {"m": [5, 15, 30], "n": [1, 2, 3]}), selected)
    assert [r["value"] for r in got.orderBy("t").collect()] == [-0.5, 0.5, 2.0]


def test_vectors_follow_the_selection_order(spark):
    rows = spark.createDataFrame(
        [("a", "i", "z", 0, 6, 1.0, 2.0), ("a", "i", "b", 1, 6, 3.0, 4.0)],
        "application string, instance string, metric string, ord int, t long, l0 double, l1 double",
    )
    got = features.vectors(rows, FeatureShape(lags=1)).collect()
    assert got[0]["vec"] == [1.0, 2.0, 3.0, 4.0]
