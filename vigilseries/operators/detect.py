"""From anomaly bits to window rates, detection rows and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE


def window_rate(scores: DataFrame, keys: Sequence[str], bit_max: int) -> DataFrame:
    """Share of set bits in percent, with the first and last scored step."""
    return scores.groupBy(*keys).agg(
        (F.sum("anomaly_bit") * 100.0 / (F.count(F.lit(1)) * bit_max)).alias("rate"),
        F.min("t").alias("window_start"),
        F.max("t").alias("window_end"),
    )


def nsa_window_rate(
    scores: DataFrame, cfg: DetectorConfig, keys: Sequence[str] = INSTANCE
) -> DataFrame:
    return window_rate(scores, keys, cfg.anomaly_bit_max)


def kmeans_window_rate(
    scores: DataFrame, cfg: DetectorConfig, keys: Sequence[str] = INSTANCE
) -> DataFrame:
    return window_rate(scores, [*keys, "metric"], cfg.anomaly_bit_max)


def flagged(rates: DataFrame, limit: float) -> DataFrame:
    return rates.withColumn("anomaly", F.col("rate") >= limit)


def prediction_time(now: Column, horizon: int, margin: Column) -> Column:
    """Epoch second of the next prediction that can be ready in time. ``margin`` is the time a
    prediction takes; if it reaches into the next slot, slots are skipped."""
    next_slot = (F.floor(now / horizon) + 1) * horizon
    late = now + margin - next_slot
    skipped = F.when(late > 0, 1 + F.floor(late / horizon)).otherwise(F.lit(1))
    return (next_slot + skipped * horizon).cast("long")


def measurement_name(method: Column, node: Column, metric: Column | None = None) -> Column:
    parts = [F.lit("_predicted"), F.replace(method, F.lit(" "), F.lit("_")), node]
    return F.concat_ws("_", *parts, *([metric] if metric is not None else []))


def nsa_detections(
    rates: DataFrame, selected: DataFrame, now: int, cfg: DetectorConfig, margin: int | None = None
) -> DataFrame:
    """One row per instance, with its metrics (at most ``top_n``) in selection order. ``margin`` is
    what a cycle was measured to need, else the configured one."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "metric")))
    names = selected.groupBy(*INSTANCE).agg(F.transform(listed, lambda m: m["metric"]).alias("names"))
    found = flagged(rates, cfg.nsa_rate_limit).join(names, [*INSTANCE])
    method = F.lit(cfg.nsa_method)
    return _detection_rows(
        found, method, F.array_join("names", ","), measurement_name(method, F.col("instance")), now, cfg, margin
    )


def kmeans_detections(
    rates: DataFrame, now: int, cfg: DetectorConfig, margin: int | None = None
) -> DataFrame:
    """One row per instance and metric."""
    method = F.lit(cfg.kmeans_method)
    name = measurement_name(method, F.col("instance"), F.col("metric"))
    return _detection_rows(
        flagged(rates, cfg.kmeans_rate_limit), method, F.col("metric"), name, now, cfg, margin
    )


def _detection_rows(
    found: DataFrame, method: Column, metrics: Column, name: Column, now: int, cfg: DetectorConfig,
    margin: int | None,
) -> DataFrame:
    needed = F.lit(cfg.safety_margin if margin is None else margin)
    slot = prediction_time(F.lit(now).cast("long"), cfg.horizon, needed)
    return found.select(
        F.timestamp_seconds(F.lit(now)).alias("time"),
        name.alias("measurement"),
        F.col("application").alias("application_name"),
        F.col("instance").alias("node"),
        method.alias("method"),
        metrics.alias("metrics"),
        F.lit(str(cfg.level)).alias("level"),
        F.col("rate").alias("metricValue"),
        "anomaly",
        slot.alias("predictionTime"),
        "window_start",
        "window_end",
    )


def alerts(detections: DataFrame, now: int, cfg: DetectorConfig) -> DataFrame:
    """Messages for flagged rows only: ``topic, application, body``. ``metrics`` is a list in
    multivariate alerts and a name in univariate ones."""
    return alerts_at(detections, F.lit(now), cfg)


def alerts_at(detections: DataFrame, now: Column, cfg: DetectorConfig) -> DataFrame:
    utc = F.to_utc_timestamp(F.timestamp_seconds(now), F.current_timezone())
    when = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def body(metrics: Column) -> Column:
        return F.to_json(
            F.struct(
                when.alias("when"),
                F.col("method"),
                F.col("level").cast("int").alias("level"),
                F.col("application_name").alias("application"),
                F.col("node"),
                F.unix_seconds("time").alias("timestamp"),
                F.col("predictionTime"),
                F.col("window_start"),
                F.col("window_end"),
                F.col("metricValue").alias("window_anomaly_rate"),
                metrics.alias("metrics"),
            )
        )

    text = F.when(F.col("method") == cfg.nsa_method, body(F.split("metrics", ","))).otherwise(
        body(F.col("metrics"))
    )
    return detections.where("anomaly").select(
        F.lit(f"topic://{cfg.topic_prefix}allmetrics").alias("topic"),
        F.col("application_name").alias("application"),
        text.alias("body"),
    )


def model_for_cycle(cycles: DataFrame, models: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The newest model trained at or before a cycle that has not yet served its cycles.

    A model serves a fixed number of cycle slots, so it is listed under each of them and found by
    equality; no cycle is compared with all models. ``cycles`` has ``cycle_at`` on multiples of the
    horizon, ``models`` has ``trained_at`` and ``model_id``.
    """
    h = cfg.horizon
    first = F.ceil(F.col("trained_at") / h) * h
    slots = F.explode(F.array(*[first + i * h for i in range(cfg.cycles_per_model)]))
    newest = (
        models.select(*INSTANCE, "model_id", "trained_at", slots.alias("cycle_at"))
        .groupBy(*INSTANCE, "cycle_at")
        .agg(
            F.max_by("model_id", F.struct("trained_at", "model_id")).alias("model_id"),
            F.max("trained_at").alias("trained_at"),
        )
    )
    return cycles.join(newest, [*INSTANCE, "cycle_at"], "left")
