import glob
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from vigilseries.config import DAY, DetectorConfig
from vigilseries.functions.storage import FileTree
from vigilseries.operators import detect
from vigilseries.sources import control, points, store, upserts

NOW = 1_000_000
CFG = DetectorConfig(freq=60, train_seconds=1000, score_seconds=200)


def raw(spark, rows):
    return spark.createDataFrame(
        rows,
        "application string, instance string, measurement string, destination_key string, "
        "field string, s long, value double",
    ).selectExpr("application", "instance", "measurement", "destination_key", "field",
                 "timestamp_seconds(s) ts", "value")


def point(s, measurement="adt_m", instance="i", key="k", field="value", value=1.0, app="a"):
    return (app, instance, measurement, key, field, s, value)


def seconds(frame):
    return sorted(r["s"] for r in frame.select(F.unix_seconds("ts").alias("s")).collect())


def test_ranges_are_adjacent_and_half_open(spark):
    edge = NOW - 200
    rows = raw(spark, [point(s) for s in (edge - 1001, edge - 1000, edge - 1, edge, NOW - 1, NOW)])
    assert seconds(points.training_range(rows, NOW, CFG)) == [edge - 1000, edge - 1]
    assert seconds(points.scoring_range(rows, NOW, CFG)) == [edge, NOW - 1]


def test_range_reaches_the_store(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = [point(d * DAY + h * 3600, app=a) for a in "ab" for d in range(4) for h in range(3)]
    store.write_points(raw(spark, rows), path)
    stored = points.read_points(spark, path)
    assert stored.count() == len(rows)
    got = points.with_prefix(points.in_range(stored, DAY, 2 * DAY), "adt_").where("application = 'a'")
    assert got.count() == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [" in plan and "isnotnull(date" in plan
    assert "StringStartsWith(measurement,adt_)" in plan
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_the_store_does_not_depend_on_the_session_time_zone(spark, tmp_path):
    path = str(tmp_path / "points")
    rows = raw(spark, [point(d * DAY + h * 1800) for d in range(3) for h in range(48)])
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        store.write_points(rows, path)
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert points.in_range(points.read_points(spark, path), DAY, 2 * DAY).count() == 48
        assert store.retained(points.read_points(spark, path), 3 * DAY, DAY).count() == 48
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scans(spark):
    rows = raw(
        spark,
        [
            point(NOW - 10),
            point(NOW - 10, field="raw"),
            point(NOW - 10, key="x, y"),
            point(NOW - 10, measurement="sys_m"),
            point(NOW - 100),
            point(NOW),
        ],
    )
    found = points.scan_metric(rows, "adt_m", "i", "k", NOW - 50, NOW)
    assert sorted(r["field"] for r in found.collect()) == ["raw", "value"]
    assert points.scan_field(rows, "adt_m", "value", NOW - 50, NOW).count() == 2
    assert seconds(points.scan_recent(rows.where("field = 'value' and destination_key = 'k'"), "adt_m", NOW)) == [
        NOW - 10, NOW,
    ]
    assert points.with_prefix(rows, "adt_").count() == 5


def test_discovery(spark):
    rows = raw(
        spark,
        [point(NOW - 5, instance=i) for i in ("c", "a", "b", "", None)]
        + [point(NOW - 2 * DAY, instance="old"), point(NOW - 5, instance="d", measurement="sys")]
        + [point(NOW - 5, instance="a", measurement="adt_b", key=k) for k in ("z", "x,y", "x, y")],
    )
    found = points.discover_instances(rows, NOW, CFG)
    assert sorted(r["instance"] for r in found.collect()) == ["a", "b", "c"]
    capped = points.discover_instances(rows, NOW, DetectorConfig(max_instances=2))
    assert sorted(r["instance"] for r in capped.collect()) == ["a", "b"]
    metrics = points.discover_metrics(rows.where("instance = 'a'"), NOW - 100, NOW, "adt_")
    assert [(r["ord"], r["metric"]) for r in metrics.orderBy("ord").collect()] == [
        (0, "adt_b_x---y"), (1, "adt_b_x--y"), (2, "adt_b_z"), (3, "adt_m_k"),
    ]


def message(offset, body, topic="topic://monitoring.metric_list", at=0, subject="s"):
    return (topic, subject, json.dumps(body), at, offset)


def messages(spark, rows):
    return spark.createDataFrame(
        rows, "topic string, subject string, body string, at long, offset long"
    ).selectExpr("topic", "subject", "body", "timestamp_seconds(at) received_at", "offset")


def test_registry(spark):
    rows = messages(
        spark,
        [
            message(1, {"name": "x", "version": 1}),
            message(2, {"name": "x", "version": 7}, at=5),
            message(3, {"name": "x", "version": 3}, at=5),
            message(4, {"name": "y"}),
            message(5, {"version": 9}),
            message(6, {"name": ""}),
            message(7, {"name": "z", "version": 1}, topic="topic://monitoring.realtime.z"),
            message(8, {"name": "w", "version": 1, "metric_list": [
                {"name": "m", "lower_bound": "-Infinity", "upper_bound": "Infinity"}]}, subject="w"),
        ],
    )
    parsed = control.control_messages(rows)
    assert parsed.count() == 7
    got = {r["application"]: r["version"] for r in control.registry(parsed).collect()}
    assert got == {"x": 3, "y": 0, "w": 1}
    one = control.for_subject(parsed, "w").collect()
    assert len(one) == 1 and one[0]["metric_list"][0]["upper_bound"] == "Infinity"
    prefixed = rows.withColumn("topic", F.replace("topic", F.lit("topic://"), F.lit("topic://org.")))
    assert control.control_messages(prefixed, "org.").count() == 7
    points_frame = raw(spark, [point(1, app=a) for a in "wxq"])
    kept = points.monitored(points_frame, control.registry(parsed))
    assert sorted(r["application"] for r in kept.collect()) == ["w", "x"]


def test_prediction_time(spark):
    cases = [(1000, 100, 1500), (1000, 250, 1500), (1000, 600, 1800), (1000, 200, 1500), (1200, 0, 1800),
             (1199, 2, 1500), (1000, 201, 1500), (1000, 500, 1800)]
    for now, margin, want in cases:
        got = spark.range(1).select(
            detect.prediction_time(F.lit(now).cast("long"), 300, F.lit(margin)).alias("x")
        ).first()["x"]
        assert got == want, (now, margin)


def rates(spark, rows):
    return spark.createDataFrame(
        rows, "application string, instance string, metric string, rate double, window_start long, window_end long"
    )


def test_detection_rows_and_alerts(spark, tmp_path):
    selected = spark.createDataFrame(
        [("a", "n 1", "z", 0), ("a", "n 1", "b", 1)],
        "application string, instance string, metric string, ord int",
    )
    whole = rates(spark, [("a", "n 1", None, 20.0, 10, 20)]).drop("metric")
    single = rates(spark, [("a", "n 1", "z", 19.99, 10, 20), ("a", "n 1", "b", 20.0, 10, 20)])
    cfg = DetectorConfig(method_prefix="my ", topic_prefix="org.")
    found = detect.nsa_detections(whole, selected, NOW, cfg).unionByName(
        detect.kmeans_detections(single, NOW, cfg)
    )
    got = {r["measurement"]: r for r in found.collect()}
    assert set(got) == {"_predicted_my_nsa_n 1", "_predicted_my_kmeans_n 1_z", "_predicted_my_kmeans_n 1_b"}
    nsa = got["_predicted_my_nsa_n 1"]
    assert (nsa["metrics"], nsa["level"], nsa["anomaly"], nsa["method"]) == ("z,b", "3", True, "my nsa")
    assert [got[f"_predicted_my_kmeans_n 1_{m}"]["anomaly"] for m in "zb"] == [False, True]
    sent = detect.alerts(found, NOW, cfg).collect()
    assert {r["topic"] for r in sent} == {"topic://org.allmetrics"} and len(sent) == 2
    bodies = {json.loads(r["body"])["method"]: json.loads(r["body"]) for r in sent}
    assert bodies["my nsa"]["metrics"] == ["z", "b"] and bodies["my kmeans"]["metrics"] == "b"
    assert bodies["my nsa"]["when"] == datetime.fromtimestamp(NOW, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert bodies["my nsa"]["window_anomaly_rate"] == 20.0 and bodies["my nsa"]["timestamp"] == NOW

    path = str(tmp_path / "store")
    store.append_detections(found, path, 1)
    store.append_detections(found.withColumn("metricValue", F.lit(77.0)), path, 2)
    kept = store.latest(store.read_detections(spark, path))
    assert {r["metricValue"] for r in kept.collect()} == {77.0} and kept.count() == 3
    stored = store.read_detections(spark, path)
    fields = store.recent_detections(store.latest(stored), "a", NOW + 1)
    assert fields.count() == 15
    assert store.kmeans_over(stored, NOW + 1, cfg).columns == ["time", "node", "metrics", "anomaly_rate"]
    assert store.kmeans_over(stored, NOW + 1, cfg).count() == 2
    assert store.nsa_mean_by_node(stored, NOW + 1, cfg).first()["mean_rate"] == pytest.approx(77.0)
    twice = stored.unionByName(store.read_detections(spark, path).withColumn("metricValue", F.lit(78.0)))
    assert {r["metricValue"] for r in store.latest(twice).collect()} == {78.0}  # same time of writing


def test_window_rate(spark):
    scores = spark.createDataFrame(
        [("a", "i", t, 0.0, int(t < 2)) for t in range(8)],
        "application string, instance string, t long, distance_score double, anomaly_bit int",
    )
    got = detect.nsa_window_rate(scores, CFG).first()
    assert (got["rate"], got["window_start"], got["window_end"]) == (25.0, 0, 7)
    assert detect.nsa_window_rate(scores.where("t > 99"), CFG).count() == 0


def test_model_for_cycle(spark):
    cfg = DetectorConfig(horizon=300, cycles_per_model=12)
    cycles = spark.createDataFrame(
        [("a", "i", 300 * n) for n in range(0, 20)], "application string, instance string, cycle_at long"
    )
    models = spark.createDataFrame(
        [("a", "i", 1, 600), ("a", "i", 2, 1000), ("a", "j", 3, 0)],
        "application string, instance string, model_id long, trained_at long",
    )
    got = {r["cycle_at"] // 300: r["model_id"] for r in detect.model_for_cycle(cycles, models, cfg).collect()}
    want = {n: None for n in range(20)} | {2: 1, 3: 1} | {n: 2 for n in range(4, 16)}
    assert got == want


def test_retention_and_purge(spark):
    rows = raw(spark, [point(s, m) for s in (10, 20, 30) for m in ("adt_m", "adt_n")])
    assert seconds(store.retained(rows, 40, 20)) == [20, 20, 30, 30]
    assert seconds(store.purged(rows, 10, 20)) == [30, 30]
    assert seconds(store.purged(rows, 10, 20, "adt_m")) == [10, 20, 30, 30]


def test_csv_round_trip(spark, tmp_path):
    """One file per series: header with the metric's name, rows in order of time, names that need quotes."""
    odd = 'm "x", y'
    given = [("a", "i", m, 1000 + s * 7 % 20_011, s / 4) for s in range(20_000) for m in ("adt_m", odd)]
    given += [("a", "i", "adt_m", 7, None), (None, "j", "adt_m", 5, 1.5), (None, "j", "adt_m", 5, 1.5)]
    rows = spark.createDataFrame(given, "application string, instance string, metric string, s long, value double")
    path = str(tmp_path / "csv")
    store.export_metric_csv(rows.withColumn("ts", F.timestamp_seconds("s")).repartition(5), path)
    files = [p.read_text().splitlines() for p in (tmp_path / "csv").rglob("*.csv")] or [
        p.read_text().splitlines() for p in (tmp_path / "csv").rglob("*.txt")
    ]
    assert sorted(f[0] for f in files) == sorted(
        ["Timestamp,ems_time,adt_m", "Timestamp,ems_time,adt_m", 'Timestamp,ems_time,"m \\"x\\", y"']
    )
    for lines in files:
        times = [int(line.split(",")[0]) for line in lines[1:]]
        assert times == sorted(times)
    assert any(lines[1] == "7,7,None" for lines in files)
    back = store.read_metric_csv(spark, path).collect()
    assert sorted(map(str, ((*r[:3], r["ems_time"], r["value"]) for r in back))) == sorted(map(str, given))
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "none").mkdir()
        store.read_metric_csv(spark, str(tmp_path / "none"))


def detection(at, rate, written, node="n"):
    return (at, f"_predicted_m_{node}", "a", node, "m", "x", "3", float(rate), rate > 20, at + 1, at - 9, at, written)


def detections(spark, rows):
    names = store.DETECTION_SCHEMA.names
    frame = spark.createDataFrame(rows, "time long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store.DETECTION_SCHEMA.fields[1:]))
    return frame.withColumn("time", F.timestamp_seconds("time")).select(*names)


def stored_rates(frame):
    return sorted((r["s"], r["metricValue"]) for r in frame.select(F.unix_seconds("time").alias("s"), "metricValue").collect())


def test_upserts_compaction_and_readers(spark, tmp_path):
    path = str(tmp_path / "detections")
    assert upserts.read(spark, path).count() == 0 and upserts.compact(spark, path) == 0
    upserts.upsert(detections(spark, [detection(10, 1, 1), detection(DAY + 10, 2, 1)]), path)
    upserts.upsert(detections(spark, [detection(10, 3, 2)]), path)
    upserts.upsert(detections(spark, [detection(10, 4, 0)]), path)  # older than what is there
    assert stored_rates(upserts.read(spark, path)) == [(10, 3.0), (DAY + 10, 2.0)]
    early = upserts.read(spark, path)  # a reader on its way
    assert upserts.compact(spark, path) == 2
    upserts.upsert(detections(spark, [detection(DAY + 10, 5, 3), detection(2 * DAY, 6, 3)]), path)
    assert stored_rates(early) == [(10, 3.0), (DAY + 10, 2.0)]
    assert stored_rates(upserts.read(spark, path)) == [(10, 3.0), (DAY + 10, 5.0), (2 * DAY, 6.0)]
    assert upserts.compact(spark, path) == 2  # the first day is not written again
    assert stored_rates(upserts.read(spark, path)) == [(10, 3.0), (DAY + 10, 5.0), (2 * DAY, 6.0)]
    assert stored_rates(store.latest(upserts.entries(spark, path, DAY, 2 * DAY - 1))) == [(DAY + 10, 5.0)]
    upserts.forget(spark, path, "1970-01-02")
    upserts.vacuum(spark, path)
    assert stored_rates(upserts.read(spark, path)) == [(DAY + 10, 5.0), (2 * DAY, 6.0)]
    left = {f for f in glob.glob(f"{path}/*-*/day=*")}
    assert len(left) == 2 and len(glob.glob(f"{path}/manifests/*.json")) == 1


def test_a_write_during_compaction_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "detections")
    upserts.upsert(detections(spark, [detection(10, 1, 1)]), path)
    write = upserts._write

    def slow(rows, files, kind):
        done = write(rows, files, kind)
        if kind == "base":
            monkeypatch.setattr(upserts, "_write", write)
            upserts.upsert(detections(spark, [detection(10, 7, 2)]), path)
        return done

    monkeypatch.setattr(upserts, "_write", slow)
    upserts.compact(spark, path)
    assert stored_rates(upserts.read(spark, path)) == [(10, 7.0)]


def test_a_lost_race_for_the_manifest_is_run_again(spark, tmp_path):
    files = FileTree(spark, str(tmp_path / "t"))
    files.write("manifests/a.draft", b"{}")
    files.write("manifests/b.draft", b"{}")
    assert files.rename("manifests/a.draft", "manifests/1.json")
    assert not files.rename("manifests/b.draft", "manifests/1.json")
    assert files.names("manifests") == ["1.json"] and files.read("manifests/1.json") == b"{}"
    assert files.names("nothing") == []


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/application=*/date=*/*.parquet")}


def test_retention_and_deletes_touch_their_days_only(spark, tmp_path):
    path = str(tmp_path / "points")
    apps = ["a", "b c", "d:e"]
    rows = [point(d * DAY + h * 3600, app=a) for a in apps for d in range(4) for h in range(24)]
    store.write_points(raw(spark, rows), path)
    before = stamps(path)
    store.drop_expired(spark, path, 4 * DAY, 3 * DAY - 6 * 3600)  # six hours of the second day go, too
    kept = points.read_points(spark, path)
    assert seconds(kept) == sorted(s for _ in apps for s in range(DAY + 6 * 3600, 4 * DAY, 3600))
    after = stamps(path)
    assert {f for f in after if "date=1970-01-01" in f} == set()
    old = {f: t for f, t in before.items() if "date=1970-01-03" in f or "date=1970-01-04" in f}
    assert len(old) >= 6 and all(after[f] == t for f, t in old.items())

    before = stamps(path)
    store.delete_points(spark, path, 2 * DAY, 3 * DAY + 3600 * 2)  # a day and three hours of the next
    assert seconds(points.read_points(spark, path)) == sorted(
        s for _ in apps for s in [*range(DAY + 6 * 3600, 2 * DAY, 3600), *range(3 * DAY + 3 * 3600, 4 * DAY, 3600)]
    )
    after = stamps(path)
    assert all(after[f] == t for f, t in before.items() if "date=1970-01-02" in f)

    before = stamps(path)
    store.delete_points(spark, path, 0, 9 * DAY, "other")  # nothing of that name
    assert stamps(path) == before
    store.delete_points(spark, path, 0, 9 * DAY, rows[0][2])
    assert points.read_points(spark, path).count() == 0 and stamps(path) == {}
