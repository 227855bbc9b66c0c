"""Reading raw metric points and finding out which instances and metrics exist.

Canonical point frame: ``application, instance, measurement, destination_key, ts, value``
(plus ``field`` where the store has several fields). One scan serves the whole fleet; every
function takes the current time ``now`` (epoch seconds) as a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.config import DAY, MINUTE, DetectorConfig
from vigilseries.functions.columns import encode_destination, metric_name, missing_if_nan, utc_day

POINT_SCHEMA = T.StructType(
    [
        T.StructField("application", T.StringType()),
        T.StructField("instance", T.StringType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("destination_key", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The point store: Parquet partitioned by ``application`` and ``date``."""
    schema = T.StructType([*POINT_SCHEMA.fields, T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def in_range(points: DataFrame, start: int, stop: int) -> DataFrame:
    """Points in ``[start, stop)``; both bounds reach the Parquet scan."""
    lo, hi = F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(stop))
    inside = (F.col("ts") >= lo) & (F.col("ts") < hi)
    if "date" in points.columns:  # prunes whole partitions of the store
        inside = inside & F.col("date").between(utc_day(F.lit(start)), utc_day(F.lit(stop)))
    return points.where(inside)


def training_range(points: DataFrame, now: int, cfg: DetectorConfig) -> DataFrame:
    stop = now - cfg.score_seconds
    return in_range(points, stop - cfg.train_seconds, stop)


def scoring_range(points: DataFrame, now: int, cfg: DetectorConfig) -> DataFrame:
    return in_range(points, now - cfg.score_seconds, now)


def with_prefix(points: DataFrame, prefix: str) -> DataFrame:
    return points.where(F.col("measurement").startswith(prefix))


def scan_metric(
    points: DataFrame, measurement: str, instance: str, destination_key: str, start: int, stop: int
) -> DataFrame:
    """All fields of one measurement, instance and (decoded) destination key in a range."""
    return in_range(points, start, stop).where(
        (F.col("measurement") == measurement)
        & (F.col("instance") == instance)
        & (F.col("destination_key") == destination_key)
    )


def scan_field(points: DataFrame, measurement: str, field: str, start: int, stop: int) -> DataFrame:
    return in_range(points, start, stop).where(
        (F.col("measurement") == measurement) & (F.col("field") == field)
    )


def scan_recent(points: DataFrame, measurement: str, now: int, seconds: int = MINUTE) -> DataFrame:
    """Points of one measurement that are at most ``seconds`` old."""
    return points.where(
        (F.col("measurement") == measurement)
        & (F.col("ts") >= F.timestamp_seconds(F.lit(now - seconds)))
        & (F.col("ts") <= F.timestamp_seconds(F.lit(now)))
    )


def series_points(points: DataFrame, prefix: str) -> DataFrame:
    """Points of the monitored metrics with ``measurement, destination`` (encoded) and ``metric``."""
    return with_prefix(points, prefix).where(F.col("destination_key").isNotNull()).select(
        "application",
        "instance",
        "measurement",
        encode_destination(F.col("destination_key")).alias("destination"),
        metric_name(F.col("measurement"), F.col("destination_key")).alias("metric"),
        "ts",
        missing_if_nan(F.col("value").cast("double")).alias("value"),
    )


def discover_instances(points: DataFrame, now: int, cfg: DetectorConfig) -> DataFrame:
    """Distinct non-empty instances of the last days, optionally the first n per application."""
    recent = in_range(with_prefix(points, cfg.metric_prefix), now - cfg.discovery_days * DAY, now)
    found = (
        recent.where(F.col("instance").isNotNull() & (F.col("instance") != ""))
        .select("application", "instance")
        .distinct()
    )
    if cfg.max_instances is None:
        return found
    order = Window.partitionBy("application").orderBy("instance")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= cfg.max_instances)
        .drop("rank")
    )


def discover_metrics(points: DataFrame, start: int, stop: int, prefix: str) -> DataFrame:
    """Metrics per instance with their position ``ord`` (order of measurement, encoded key)."""
    rows = series_points(in_range(points, start, stop), prefix)
    return numbered(
        rows.select("application", "instance", "measurement", "destination", "metric").distinct()
    )


def numbered(metrics: DataFrame) -> DataFrame:
    """``metric, ord`` per instance in the order of measurement and encoded key."""
    order = Window.partitionBy("application", "instance").orderBy("measurement", "destination")
    return metrics.select(
        "application", "instance", "metric", (F.row_number().over(order) - 1).alias("ord")
    )


def monitored(points: DataFrame, registry: DataFrame) -> DataFrame:
    """Only the points of registered applications."""
    return points.join(registry.select("application"), "application", "left_semi")
