from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from vigilseries.config import DetectorConfig
from vigilseries.operators import align

CFG = DetectorConfig(freq=60)
SCHEMA = "application string, instance string, metric string, t long, value double"


def means(spark, series):
    """{metric: {step: value}} on a one-minute grid."""
    rows = [
        ("a", "i", metric, 60 * step, None if v is None else float(v))
        for metric, points in series.items()
        for step, v in points.items()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def collected(frame):
    out = {}
    for r in frame.orderBy("metric", "t").collect():
        out.setdefault(r["metric"], []).append(r["value"])
    return out


@pytest.mark.parametrize("steps", [100, None])
def test_gaps(spark, steps):
    frame = means(spark, {"m": {1: 1, 4: 4}, "other": {0: 9, 6: 9}})
    got = collected(align.align_means(frame, CFG, steps=steps))
    assert got == {"m": [0, 1, 2, 3, 4, 4, 4], "other": [9] * 7}
    raw = collected(align.interpolate(frame, CFG, steps=steps))
    assert raw["m"][0] is None and raw["m"][1:] == [1, 2, 3, 4, 4, 4]
    holes = collected(align.reindex(frame, CFG, steps=steps))
    assert holes["m"] == [None, 1, None, None, 4, None, None]


@pytest.mark.parametrize("steps", [100, None])
def test_missing_values_extend_the_spine_but_are_not_known(spark, steps):
    frame = means(spark, {"m": {0: None, 1: 5, 3: None}, "never": {2: None}})
    got = collected(align.align_means(frame, CFG, steps=steps))
    assert got == {"m": [0, 5, 5, 5], "never": [0, 0, 0, 0]}


def test_long_series_in_chunks_equal_pandas(spark):
    rng = np.random.default_rng(3)
    series = {}
    for metric in "abc":
        known = sorted(rng.choice(200, 25, replace=False))
        series[metric] = {int(s): round(float(rng.normal()), 3) for s in known}
    series["late"] = {190: 1.0, 199: 2.0}
    frame = means(spark, series)
    wide = pd.DataFrame(series)
    wide = wide.reindex(range(wide.index.min(), wide.index.max() + 1)).sort_index()
    want = wide.interpolate(method="linear").fillna(0)
    for cfg, steps in ((CFG, 1000), (replace(CFG, chunk_steps=16), None)):
        got = collected(align.align_means(frame, cfg, steps=steps))
        for metric in series:
            assert np.allclose(got[metric], want[metric].to_numpy())


def test_grid_means_and_spine(spark):
    rows = [("a", "i", "m", s, v) for s, v in [(0, 1.0), (59, 3.0), (60, 10.0), (185, 4.0)]]
    points = spark.createDataFrame(
        rows, "application string, instance string, metric string, s long, value double"
    ).selectExpr("application", "instance", "metric", "timestamp_seconds(s) ts", "value")
    got = align.grid_means(points, 60).orderBy("t").collect()
    assert [(r["t"], r["value"], r["records"]) for r in got] == [(0, 2, 2), (60, 10, 1), (180, 4, 1)]
    steps = align.spine(align.grid_means(points, 60), 60).orderBy("t").collect()
    assert [r["t"] for r in steps] == [0, 60, 120, 180]
    full = collected(align.align(points, CFG))
    assert full == {"m": [2, 10, 7, 4]}
    again = collected(align.resample(align.align(points, CFG), CFG))
    assert again == full


def test_wide_and_back(spark):
    frame = means(spark, {"m": {0: 1, 1: 2}, "n": {0: 3, 1: 4}})
    wide = align.pivot_wide(frame, ["m", "n"])
    assert wide.columns == ["application", "instance", "t", "m", "n"]
    csv = wide.selectExpr("application", "instance", "t Timestamp", "t ems_time", "m", "n")
    assert collected(align.wide_to_long(csv, ["m", "n"])) == {"m": [1, 2], "n": [3, 4]}


def test_dropping_incomplete_scores_needs_no_outer_join(spark):
    values = means(spark, {"m": {0: 1, 1: 2}})
    scores = means(spark, {"m": {1: 7}}).withColumnRenamed("value", "anomaly_score")
    on = ["application", "instance", "metric", "t"]
    assert align.outer_scores(values, scores, on).count() == 2
    kept = align.complete_scores(values, scores, on, ["value", "anomaly_score"])
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "FullOuter" not in plan


def test_alignment_generates_the_grid_without_shuffling_it(spark):
    frame = means(spark, {"m": {0: 1, 5: 2}})
    plan = align.align_means(frame, CFG, steps=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")  # nothing is shuffled after it
