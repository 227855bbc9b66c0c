"""The whole run on a small fleet: invariances, injected anomalies, streaming against batch."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.plans import pipeline
from vigilseries.sources.models import load_models, save_models
from vigilseries.streaming import rings, streams

NOW = 720_000
CFG = DetectorConfig(
    freq=60, train_seconds=200 * 60, score_seconds=60 * 60, max_detectors=40, top_n=3, min_records=50
)
RAW = (
    "application string, instance string, measurement string, destination_key string, s long, value double"
)


def fleet(spark, instances, jumps=(), metrics=5, seed=0):
    rows = []
    for inst in instances:
        rng = np.random.default_rng([seed, *inst.encode()])
        for m in range(metrics):
            x = np.sin(np.arange(260) / (5 + 3 * m)) * 5 + rng.normal(0, 0.3, 260)
            if (inst, m) in jumps:
                x[215:255:2] += 60
            for step, v in enumerate(x):
                s = NOW - 260 * 60 + step * 60 + int(rng.integers(0, 60))
                rows.append(("app", inst, f"adt_m{m}", "k,1", s, float(v)))
    return spark.createDataFrame(rows, RAW).selectExpr(
        "application", "instance", "measurement", "destination_key", "timestamp_seconds(s) ts", "value"
    )


def rows_of(frame):
    return sorted(
        (r["measurement"], r["metrics"], round(r["metricValue"], 9), r["anomaly"], r["window_start"], r["window_end"])
        for r in frame.collect()
    )


@pytest.fixture(scope="module")
def base(spark):
    points = fleet(spark, ["calm", "wild"], {("wild", 0), ("wild", 1)}).cache()
    models = pipeline.train(points, NOW, CFG)
    return points, models, rows_of(pipeline.detections(points, models, NOW, CFG))


def test_jumps_are_flagged_and_calm_is_not(base):
    found = {(r[0], r[1]): r for r in base[2]}
    assert len(base[2]) == 2 + 2 * 3
    for (name, metric), row in found.items():
        if "_wild" in name and (metric.startswith(("adt_m0", "adt_m1")) or "nsa" in name):
            assert row[3] and row[2] > 50
        if "_calm" in name:
            assert not row[3]
        assert row[4] == NOW - 60 * 60 + 11 * 60 and row[5] == NOW - 60


def test_other_instances_and_row_order_change_nothing(spark, base):
    points, _, want = base
    more = points.unionByName(fleet(spark, ["extra"], seed=9)).repartition(7).orderBy(F.rand(3))
    got = rows_of(pipeline.detections(more, pipeline.train(more, NOW, CFG), NOW, CFG))
    assert [r for r in got if not r[0].endswith("extra") and "_extra_" not in r[0]] == want


def test_split_paths_give_the_same_result(spark, base, monkeypatch):
    """Small chunks and blocks: long series, many vectors and many metrics take the split plans."""
    from vigilseries.functions import quantiles
    from vigilseries.operators import kmeans, neighbours, nsa, select

    monkeypatch.setattr(neighbours, "BLOCK", 37)
    monkeypatch.setattr(select, "METRIC_BLOCK", 2)
    for module in (quantiles, kmeans, nsa):
        monkeypatch.setattr(module, "IN_MEMORY_ROWS", 10)
    points, _, want = base
    cfg = replace(CFG, chunk_steps=23)
    got = rows_of(pipeline.detections(points, pipeline.train(points, NOW, cfg), NOW, cfg))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_one_method_alone(spark, base):
    points, _, want = base
    for cfg, word in ((replace(CFG, use_nsa=False), "kmeans"), (replace(CFG, use_kmeans=False), "nsa")):
        got = rows_of(pipeline.detections(points, pipeline.train(points, NOW, cfg), NOW, cfg))
        assert got == [r for r in want if word in r[0]]
    with pytest.raises(ValueError, match="switched off"):
        none = replace(CFG, use_nsa=False, use_kmeans=False)
        pipeline.detections(points, pipeline.train(points, NOW, none), NOW, none)


def test_a_missing_metric(spark, base):
    """Without data for a selected metric: no multivariate result, univariate ones as far as there
    is data; in strict mode none."""
    points, models, _ = base
    edge = F.timestamp_seconds(F.lit(NOW - CFG.score_seconds))
    gone = models.selected.where("instance = 'wild' and ord = 0").first()["metric"]
    lost = (F.col("instance") == "wild") & (F.col("ts") >= edge) & (
        F.concat("measurement", F.lit("_k--1")) == gone
    )
    fewer = points.where(~lost)
    got = rows_of(pipeline.detections(fewer, models, NOW, CFG))
    assert sum("_wild" in r[0] for r in got) == 2 and not any("nsa_wild" in r[0] for r in got)
    strict = rows_of(pipeline.detections(fewer, models, NOW, replace(CFG, strict_instances=True)))
    assert len(strict) == 4 and all("_calm" in r[0] for r in strict)


def test_saved_models_score_the_same(spark, base, tmp_path):
    points, models, want = base
    folder = str(tmp_path / "model")
    saved = save_models(models, folder)
    assert rows_of(pipeline.detections(points, saved, NOW, CFG)) == want
    loaded = load_models(spark, folder, use_nsa=False)
    got = rows_of(pipeline.detections(points, loaded, NOW, CFG))
    assert got == [r for r in want if "kmeans" in r[0]]


def test_outlier_stage(spark, base):
    points, _, want = base
    spiked = points.withColumn(
        "value", F.when(F.unix_seconds("ts") < NOW - 250 * 60, F.lit(1e6)).otherwise(F.col("value"))
    )
    cfg = replace(CFG, iqr_filter=True)
    frame = pipeline.TrainingRun(spiked, NOW, cfg).aligned
    assert frame.agg(F.max("value")).first()[0] < 100


@pytest.mark.parametrize("windows", [streams.sliding_windows, rings.carried_windows])
def test_stream_equals_batch(spark, base, tmp_path, windows):
    points, models, want = base
    source = str(tmp_path / "in")
    later = spark.createDataFrame(
        [("app", "late", "adt_z", "k", NOW + 3600, 0.0)], RAW
    ).selectExpr("application", "instance", "measurement", "destination_key", "timestamp_seconds(s) ts", "value")
    points.unionByName(later).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(points.schema).parquet(source).selectExpr(
        "application", "instance",
        "concat(measurement, '_', replace(destination_key, ',', '--')) metric", "ts", "value",
    )
    means = streams.grid_mean_stream(stream, CFG)
    sink = streams.detection_sink(
        windows(means, CFG, 300),
        lambda: models,
        CFG,
        str(tmp_path / "detections"),
        str(tmp_path / "alerts"),
        str(tmp_path / "checkpoint"),
    )
    with rings.state_store(spark):
        streams.run_available(sink)
    stored = spark.read.parquet(str(tmp_path / "detections"))
    now = stored.where(F.unix_seconds("time") == NOW)
    assert rows_of(now) == want
    assert stored.select("time").distinct().count() > 20
    alerts = spark.read.json(str(tmp_path / "alerts"))
    assert alerts.count() == stored.where("anomaly").count() > 0
    with rings.state_store(spark):
        streams.run_available(sink)  # nothing new: nothing is written twice
    assert spark.read.parquet(str(tmp_path / "detections")).count() == stored.count()


def test_cycles_record_what_they_leave_out_and_how_long_they_take(spark, base, tmp_path):
    from vigilseries.plans import cycles
    from vigilseries.sources import upserts

    points, models, want = base
    store, status = str(tmp_path / "store"), str(tmp_path / "status")
    silent = points.where(~((F.col("instance") == "wild") & (F.col("ts") >= F.timestamp_seconds(F.lit(NOW - 3600)))))
    assert cycles.margin(spark, status, CFG) == CFG.safety_margin
    for _ in range(2):  # again for the same time: nothing is stored twice
        cycles.run(points, models, NOW, CFG, store, status)
    assert rows_of(upserts.read(spark, store)) == want
    assert cycles.read_skipped(spark, status).count() == 0
    done = cycles.read_cycles(spark, status).collect()
    assert len(done) == 2 and all(r.seconds >= 1 and r.detections == len(want) for r in done)
    assert all(r.flagged == sum(w[3] for w in want) for r in done)

    cycles.record(spark, status, NOW, 701.2, 1, 0)  # one that took longer than two horizons
    assert cycles.margin(spark, status, CFG) == 702
    cycles.run(silent, models, NOW + 7, CFG, store, status)
    skipped = {(r.instance, r.metric, r.reason) for r in cycles.read_skipped(spark, status).collect()}
    assert ("wild", None, cycles.INCOMPLETE) in skipped and sum(r[2] == cycles.MISSING for r in skipped) == 5
    assert not any(r[0] == "calm" for r in skipped)
    times = {r.predictionTime - NOW for r in upserts.read(spark, store).where(F.unix_seconds("time") == NOW + 7).collect()}
    assert times == {900}  # a slot is skipped: 600 with the configured margin

    few = cycles.left_out_of_training(points, NOW, replace(CFG, min_records=10_000))
    assert sorted((r.instance, r.reason) for r in few.where("metric is null").collect()) == [
        ("calm", cycles.NO_DATA), ("wild", cycles.NO_DATA)
    ]
    assert few.where(F.col("reason") == cycles.FEW).count() == 10
