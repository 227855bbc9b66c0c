"""Stage storage, and the plans of large groups when nothing may be broadcast."""

import os
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions import storage
from vigilseries.functions.columns import INSTANCE
from vigilseries.functions.quantiles import at_ranks, bracketed_quantiles, grouped_quantiles
from vigilseries.operators import kmeans, nsa


def session(master, setting=None, known=None):
    there = SimpleNamespace(isDefined=lambda: known is not None, get=lambda: known)
    context = SimpleNamespace(getCheckpointDir=lambda: there)
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        _jsc=SimpleNamespace(sc=lambda: context),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder():
    assert storage.shared_folder(session("spark://h:1", "hdfs://a/b/")) == "hdfs://a/b"
    assert storage.shared_folder(session("yarn", None, "hdfs://a/c/0a1b")) == "hdfs://a/c"
    assert os.path.isdir(storage.shared_folder(session("local[4]")))
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(session(master))


def test_scopes_delete_their_own_tables(spark):
    outer = storage.materialise(spark.range(3), "outer")
    with storage.stage_scope(spark):
        inner = storage.materialise(spark.range(5), "inner")
        assert inner.count() == 5
        path = inner.inputFiles()[0].removeprefix("file:")
    assert not os.path.exists(path) and outer.count() == 3


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joins(frame):
    """Partitionings below the joins of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "hashpartitioning" in line]


def test_a_large_group_meets_its_brackets_in_parts(spark, no_broadcast):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    plan = joins(bracketed_quantiles(rows, ["g"], "v", [0.25, 0.5]))
    assert sum("_salt" in line for line in plan) == 2


def test_a_candidate_of_all_instances_meets_its_walk_in_parts(spark, no_broadcast):
    rows = spark.range(200).select(
        F.lit("a").alias("application"), F.col("id").cast("string").alias("instance"),
        F.lit(0).cast("long").alias("cand"), F.array(F.lit(0.1), F.lit(0.2)).alias("centre"),
    )
    moved = nsa.perturbed(rows, DetectorConfig(), 2)
    assert any("salt" in line for line in joins(moved))
    assert moved.groupBy(*INSTANCE).count().select("count").distinct().count() == 1


def test_cluster_bits_do_not_depend_on_the_plan(spark, monkeypatch):
    """Both plans put every row into the same cluster."""
    cfg = DetectorConfig()
    names = kmeans.lag_columns(cfg.kmeans_shape)
    rows = spark.range(600).select(
        F.lit("a").alias("application"), F.lit("i").alias("instance"),
        (F.col("id") % 3).cast("string").alias("metric"), F.col("id").alias("t"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)).cast("double").alias(n) for k, n in enumerate(names)],
    )
    sides = []
    for limit in (0, 10**9):
        monkeypatch.setattr(kmeans, "IN_MEMORY_ROWS", limit)
        centres = {r.metric: (r.c0, r.c1) for r in kmeans.fit(rows, cfg, 600).collect()}
        bits = {}
        for r in rows.collect():
            near = [sum((r[n] - c[k]) ** 2 for k, n in enumerate(names)) for c in centres[r.metric]]
            bits[r.t] = near[0] <= near[1]
        sides.append(bits)
    assert sides[0] == sides[1]


def test_quantiles_are_the_same_number_on_both_paths(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 7).alias("v")
    )
    shares = [0.05, 0.25, 1 / 3, 0.5, 0.9, 0.95, 0.999]
    got = [
        {r.g: list(r.quantiles) for r in grouped_quantiles(rows, ["g"], "v", shares, bound).collect()}
        for bound in (3000, None)
    ]
    assert got[0] == got[1]


def test_percentiles_with_weights_are_the_same_number_on_both_paths(spark):
    rows = spark.range(2000).select(
        F.lit("a").alias("application"), (F.col("id") % 2).cast("string").alias("instance"),
        (F.pmod(F.xxhash64("id"), F.lit(300)) / 9).alias("near"), (1 + F.col("id") % 5).alias("n"),
    )
    for p in (0.0, 0.1, 0.5, 0.951, 1.0):
        direct = rows.groupBy(*INSTANCE).agg(F.percentile("near", F.lit(p), F.col("n")).alias("q"))
        wanted = {r.instance: r.q for r in direct.collect()}
        assert {r.instance: r.q for r in nsa.weighted_percentile(rows, p).collect()} == wanted


def test_the_value_at_a_rank(spark):
    values = [(g, float(v)) for g in "ab" for v in [5, 5, 5, 1, 2, 9, 9, 7]] + [("c", 3.0)]
    rows = spark.createDataFrame(values, "g string, v double")
    ranks = spark.createDataFrame([("a", 0, 2), ("a", 1, 7), ("b", 0, 4), ("b", 1, 0), ("c", 0, 0)], "g string, i int, rank long")
    got = {(r.g, r.i): (r.picked, r.below) for r in at_ranks(rows, ["g"], "v", ranks).collect()}
    assert got == {("a", 0): (5.0, 2), ("a", 1): (9.0, 6), ("b", 0): (5.0, 2), ("b", 1): (1.0, 0), ("c", 0): (3.0, 0)}


def test_models_do_not_depend_on_the_plan(spark, monkeypatch):
    """Thresholds, ranges and bits of both methods are equal, not nearly so, on both sides of the
    bound on rows in a task."""
    cfg = DetectorConfig(max_detectors=60, max_attempts=2)
    rows = spark.range(500).select(
        F.lit("a").alias("application"), F.lit("i").alias("instance"), F.col("id").alias("t"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)) / 70 for k in range(3)]).alias("vec"),
    )
    sides = []
    for limit in (0, 10**9):
        monkeypatch.setattr(nsa, "IN_MEMORY_ROWS", limit)
        model = nsa.train(rows, cfg, 3, 500)
        bits = nsa.score(rows, model, cfg, max_queries=500, max_points=500)
        sides.append((
            [tuple(r) for r in model.params.collect()],
            sorted((r.det_id, tuple(r.centre), r.radius) for r in model.detectors.collect()),
            sorted((r.t, r.anomaly_bit) for r in bits.collect()),
        ))
    assert sides[0] == sides[1]


def test_detectors_of_one_task_are_those_of_many(spark, monkeypatch):
    """Seeds, draws, walks and the cap, in an instance's task and as rows; two instances with
    different dimensions, one with copies."""
    cfg = DetectorConfig(max_detectors=80, max_attempts=3, self_percentage=0.08)
    value = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)) / 60
    rows = spark.range(600).select(
        F.lit("a").alias("application"), F.when(F.col("id") < 400, "i").otherwise("j").alias("instance"),
        F.col("id").alias("t"),
        F.when(F.col("id") < 400, F.array(*[value(k) for k in range(4)])).otherwise(F.array(value(0), value(1))).alias("vec"),
    )
    rows = rows.unionByName(rows.where("t % 5 = 0").withColumn("t", F.col("t") + 10_000))
    sides = []
    for limit in (2048, 0):
        monkeypatch.setattr(nsa, "BLOCK", limit)
        for mode in ("corners", "centroids", "none"):
            model = nsa.train(rows, replace(cfg, seed_mode=mode), 4, 1000)
            sides.append(sorted((r.instance, r.det_id, tuple(r.centre), r.radius) for r in model.detectors.collect()))
    assert sides[:3] == sides[3:] and all(len({r[0] for r in s}) == 2 for s in sides)


def test_no_candidate_is_a_row_where_an_instance_is_one_task(spark):
    rows = spark.range(50).select(
        F.lit("a").alias("application"), F.lit("i").alias("instance"), F.col("id").alias("rid"),
        F.array(F.col("id") / 50).alias("vec"),
    )
    known = nsa.params(rows, 0.05)
    plan = nsa.detectors(rows, rows, known, DetectorConfig(), 1, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "centre" not in "".join(joins(nsa.detectors(rows, rows, known, DetectorConfig(), 1, 50)))
