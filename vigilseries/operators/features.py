"""Scaling and time-series features.

The feature of a step is the absolute value of its smoothed difference; a feature vector holds the
newest one and ``lags`` older ones (columns ``l0 .. lL``). All look-backs are expressed over one
window specification, so a series is sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig, FeatureShape
from vigilseries.functions.columns import INSTANCE
from vigilseries.operators.chunks import over_series


def minmax_fit(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy(*INSTANCE, "metric").agg(
        F.min("value").alias("vmin"), F.max("value").alias("vmax")
    )


def minmax_transform(frame: DataFrame, selected: DataFrame) -> DataFrame:
    """Project on the selected metrics and scale by the training range, without clipping."""
    chosen = selected.select(*INSTANCE, "metric", "ord", "vmin", "vmax")
    scaled = (F.col("value") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))
    return frame.join(chosen, [*INSTANCE, "metric"]).withColumn("value", scaled).drop("vmin", "vmax")


def _past(w: WindowSpec, n: int) -> Column:
    return F.lag("value", n).over(w) if n else F.col("value")


def _feature(w: WindowSpec, shape: FeatureShape, n: int) -> Column:
    """The smoothed difference ``n`` steps ago."""
    d, s = shape.diffs, shape.smooth
    if s < 2:
        return _past(w, n) - _past(w, n + d) if d >= 1 else _past(w, n)
    if d == 1:  # the mean of s consecutive differences telescopes
        return (_past(w, n) - _past(w, n + s)) / F.lit(float(s))
    recent = F.avg("value").over(w.rowsBetween(-(n + s - 1), -n))
    if d < 1:
        return recent
    return recent - F.avg("value").over(w.rowsBetween(-(n + d + s - 1), -(n + d)))


def featurise(
    scaled: DataFrame,
    shape: FeatureShape,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    steps: int | None = None,
    scoring: bool = False,
) -> DataFrame:
    """Feature columns per metric and step; rows without a complete history are dropped.

    ``scoring`` drops the longer warm-up of a scoring window instead.
    """
    skipped = shape.warmup_rows if scoring else shape.lost_rows
    halo = max(shape.lost_rows, skipped)

    def compute(frame: DataFrame, w: WindowSpec) -> DataFrame:
        columns = [F.abs(_feature(w, shape, n)).alias(f"l{n}") for n in range(shape.width)]
        history = F.lag("t", skipped).over(w) if skipped else F.col("t")
        return (
            frame.select("*", *columns, history.alias("_history"))
            .where(F.col("_history").isNotNull())
            .drop("value", "_history")
        )

    return over_series(scaled, [*keys, "metric"], cfg, steps, halo, compute)


def lag_columns(shape: FeatureShape) -> list[str]:
    return [f"l{n}" for n in range(shape.width)]


def feature_names(metrics: Sequence[str], shape: FeatureShape) -> list[str]:
    """Names of a wide feature frame, in its (text) order."""
    if shape.lags < 1:
        return sorted(metrics)
    return sorted(f"{m}_lag{n}" for m in metrics for n in range(shape.width))


def vectors(
    features: DataFrame, shape: FeatureShape, keys: Sequence[str] = INSTANCE
) -> DataFrame:
    """One vector per instance and step: the features of its metrics (at most ``top_n``) by ``ord``."""
    entry = F.struct("ord", F.array(*lag_columns(shape)).alias("f"))
    by_metric = F.array_sort(F.collect_list(entry))
    return features.groupBy(*keys, "t").agg(
        F.flatten(F.transform(by_metric, lambda m: m["f"])).alias("vec")
    )
