"""Prediction cycles that keep a record of themselves: what was left out, and how long they took.

A cycle stores its detections, then the metrics and instances that got none with the reason, then its
duration. The longest duration so far, but never less than the configured margin, is the margin of
the next cycle: the time for which a prediction is made moves back when cycles get slower.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE, SERIES
from vigilseries.functions.storage import FileTree, stage_scope
from vigilseries.operators import gates
from vigilseries.plans import pipeline
from vigilseries.sources import points as source
from vigilseries.sources import upserts
from vigilseries.sources.store import latest

FEW = "few records"  # a metric that does not pass the gate
NO_DATA = "no data"  # an instance without any metric that does
MISSING = "missing"  # a metric with a model, but without points in the scoring window
INCOMPLETE = "incomplete"  # an instance with a missing selected metric: no multivariate result

SKIPPED = "application string, instance string, metric string, reason string"
CYCLES = "time long, seconds long, detections long, flagged long"


def left_out_of_training(points: DataFrame, now: int, cfg: DetectorConfig) -> DataFrame:
    """Metrics and discovered instances that get no model: ``application, instance, metric, reason``."""
    series = source.series_points(source.training_range(points, now, cfg), cfg.metric_prefix)
    counts = series.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("records"))
    enough = F.col("records") > cfg.min_records
    few = counts.where(~enough).select(*SERIES, F.lit(FEW).alias("reason"))
    found = source.discover_instances(points, now, cfg)
    without = gates.instances_without_data(found, counts.where(enough))
    return few.unionByName(
        without.select(*INSTANCE, F.lit(None).cast("string").alias("metric"), F.lit(NO_DATA).alias("reason"))
    )


def left_out_of_scoring(
    points: DataFrame, models: pipeline.Models, now: int, cfg: DetectorConfig
) -> DataFrame:
    """Metrics with a model and instances that get no result, or not all: as above."""
    window = source.series_points(source.scoring_range(points, now, cfg), cfg.metric_prefix)
    seen = window.select(*SERIES).distinct()
    missing = gates.missing_metrics(models.gated, seen).select(*SERIES, F.lit(MISSING).alias("reason"))
    whole = gates.complete_instances(models.selected, seen)
    refused = models.selected.select(*INSTANCE).distinct().join(whole, [*INSTANCE], "left_anti")
    return missing.unionByName(
        refused.select(*INSTANCE, F.lit(None).cast("string").alias("metric"), F.lit(INCOMPLETE).alias("reason"))
    )


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Past cycles of a status folder."""
    if not FileTree(spark, path).names("cycles"):
        return spark.createDataFrame([], CYCLES)
    return spark.read.schema(CYCLES).parquet(f"{path}/cycles")


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SKIPPED}, time long").parquet(f"{path}/skipped")


def margin(spark: SparkSession, path: str, cfg: DetectorConfig) -> int:
    """Seconds that a cycle may need: the longest so far, at least what is configured."""
    longest = read_cycles(spark, path).agg(F.max("seconds")).first()[0]
    return max(cfg.safety_margin, longest or 0)


def record(spark: SparkSession, path: str, now: int, seconds: float, found: int, flagged: int) -> None:
    row = [(now, math.ceil(seconds), found, flagged)]
    spark.createDataFrame(row, CYCLES).coalesce(1).write.mode("append").parquet(f"{path}/cycles")


def run(
    points: DataFrame, models: pipeline.Models, now: int, cfg: DetectorConfig, store: str, status: str
) -> None:
    """Score the window before ``now``, store the detections, record the cycle. Run again for the same
    ``now`` it overwrites its detections and what it left out."""
    spark, begun = points.sparkSession, time.monotonic()
    with stage_scope(spark):
        rows = pipeline.detections(points, models, now, cfg, margin(spark, status, cfg))
        upserts.upsert(rows, store, now)
        skipped = left_out_of_scoring(points, models, now, cfg)
        skipped.write.mode("overwrite").parquet(f"{status}/skipped/time={now}")
    took = time.monotonic() - begun
    stored = latest(upserts.entries(spark, store, now, now).where(F.unix_seconds("time") == now))
    found, flagged = stored.agg(F.count(F.lit(1)), F.count_if("anomaly")).first()
    record(spark, status, now, took, found, flagged)
