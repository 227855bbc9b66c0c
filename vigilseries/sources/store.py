"""Stored detections, read-back queries, retention, and the CSV layouts for interchange."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.config import DAY, DetectorConfig
from vigilseries.functions.columns import INSTANCE, SERIES, utc_day
from vigilseries.functions.storage import FileTree, materialise
from vigilseries.sources.points import POINT_SCHEMA, in_range, read_points

TAGS = ("application_name", "node", "method", "metrics", "level")
FIELDS = ("metricValue", "anomaly", "predictionTime", "window_start", "window_end")

DETECTION_SCHEMA = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("measurement", T.StringType()),
        *[T.StructField(tag, T.StringType()) for tag in TAGS],
        T.StructField("metricValue", T.DoubleType()),
        T.StructField("anomaly", T.BooleanType()),
        T.StructField("predictionTime", T.LongType()),
        T.StructField("window_start", T.LongType()),
        T.StructField("window_end", T.LongType()),
        T.StructField("written", T.LongType()),
    ]
)


def append_detections(detections: DataFrame, path: str, written: int) -> None:
    """Append to the store, partitioned by application and day. ``written`` orders writes."""
    (
        detections.withColumn("written", F.lit(written).cast("long"))
        .withColumn("application", F.col("application_name"))
        .withColumn("date", utc_day(F.unix_seconds("time")))
        .hint("rebalance", "application", "date")
        .write.mode("append")
        .partitionBy("application", "date")
        .parquet(path)
    )


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [
            *DETECTION_SCHEMA.fields,
            T.StructField("application", T.StringType()),
            T.StructField("date", T.DateType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)


def latest(detections: DataFrame) -> DataFrame:
    """Rows with the same measurement, tags and time overwrite each other: the last written stays,
    of several written at once the one with the largest values. Once more changes nothing."""
    newest = F.max(F.struct("written", *FIELDS)).alias("newest")
    return detections.groupBy("time", "measurement", *TAGS).agg(newest).select(
        "time", "measurement", *TAGS, *[F.col(f"newest.{f}").alias(f) for f in (*FIELDS, "written")]
    )


def since(detections: DataFrame, now: int, hours: int) -> DataFrame:
    lo, hi = F.timestamp_seconds(F.lit(now - hours * 3600)), F.timestamp_seconds(F.lit(now))
    inside = (F.col("time") >= lo) & (F.col("time") < hi)
    if "date" in detections.columns:
        first, last = F.lit(now - hours * 3600), F.lit(now)
        inside = inside & F.col("date").between(utc_day(first), utc_day(last))
    return detections.where(inside)


def recent_detections(
    detections: DataFrame, application: str, now: int, hours: int = 24
) -> DataFrame:
    """All detections of an application that were not overwritten, newest first, one row per field
    (values as text)."""
    rows = latest(
        since(detections, now, hours).where(
            F.col("measurement").startswith("_predicted_")
            & (F.col("application_name") == application)
        )
    )
    texts = [F.col(f).cast("string").alias(f) for f in FIELDS]
    kept = ["time", "method", "node", "metrics"]
    return (
        rows.select(*kept, *texts)
        .unpivot(kept, list(FIELDS), "field", "field_value")
        .orderBy(F.desc("time"), "node", "method", "metrics", "field")
    )


def kmeans_over(
    detections: DataFrame, now: int, cfg: DetectorConfig, limit: float = 30.0, hours: int = 6
) -> DataFrame:
    """Univariate detections whose last written rate is above a limit."""
    return (
        latest(since(detections, now, hours).where(F.col("method") == cfg.kmeans_method))
        .where(F.col("metricValue") > limit)
        .select("time", "node", "metrics", "metricValue")
        .withColumnRenamed("metricValue", "anomaly_rate")
    )


def nsa_mean_by_node(
    detections: DataFrame, now: int, cfg: DetectorConfig, hours: int = 12
) -> DataFrame:
    """Mean rate of the multivariate detections per node, as last written."""
    return (
        latest(since(detections, now, hours).where(F.col("method") == cfg.nsa_method))
        .groupBy("node")
        .agg(F.avg("metricValue").alias("mean_rate"))
    )


def retained(points: DataFrame, now: int, seconds: int) -> DataFrame:
    """Points young enough to be kept; whole older day partitions are never read."""
    oldest = F.timestamp_seconds(F.lit(now - seconds))
    young = F.col("ts") >= oldest
    if "date" in points.columns:
        young = young & (F.col("date") >= utc_day(F.lit(now - seconds)))
    return points.where(young)


def purged(points: DataFrame, start: int, stop: int, measurement: str | None = None) -> DataFrame:
    """What is left after deleting ``[start, stop]``, of one measurement or of all."""
    doomed = F.col("ts").between(F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(stop)))
    if measurement is not None:
        doomed = doomed & (F.col("measurement") == measurement)
    return points.where(~F.coalesce(doomed, F.lit(False)))


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """The point store layout. One task per application and day writes each partition, unless the
    day is large: then adaptive execution splits it."""
    dated = points.withColumn("date", utc_day(F.unix_seconds("ts")))
    (
        dated.hint("rebalance", "application", "date")
        .write.mode(mode)
        .partitionBy("application", "date")
        .parquet(path)
    )


Partition = tuple[str, str | None, str]  # directory, application, day


def _partitions(files: FileTree) -> list[Partition]:
    """The partitions of the point store, from the names of their directories."""
    found = []
    for app in (n for n in files.names() if n.startswith("application=")):
        value = unquote(app.removeprefix("application="))
        value = None if value == "__HIVE_DEFAULT_PARTITION__" else value
        found += [(f"{app}/{d}", value, d.removeprefix("date=")) for d in files.names(app) if d.startswith("date=")]
    return found


def _with_rows(points: DataFrame) -> set[tuple[str | None, str]]:
    return {(r.application, str(r.date)) for r in points.select("application", "date").distinct().collect()}


def _rewrite(spark: SparkSession, path: str, files: FileTree, touched: list[Partition], kept: Column) -> None:
    """Keep some rows of some partitions. The kept rows are written elsewhere first, then put in
    place; partitions without any are removed, all others are not touched."""
    if not touched:
        return
    schema = T.StructType([*POINT_SCHEMA.fields, T.StructField("date", T.DateType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[files.path(p) for p, _, _ in touched])
    left = materialise(rows.where(kept), "points-kept")
    (
        left.hint("rebalance", "application", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("application", "date")
        .parquet(path)
    )
    full = _with_rows(left)
    for directory, application, day in touched:
        if (application, day) not in full:
            files.delete(directory)


def drop_expired(spark: SparkSession, path: str, now: int, seconds: int) -> None:
    """Remove points older than so many seconds from the point store. Whole days go without being
    read; the day of the border is rewritten; other files stay as they are."""
    files, oldest = FileTree(spark, path), now - seconds
    border = date.fromordinal(date(1970, 1, 1).toordinal() + oldest // DAY).isoformat()
    partitions = _partitions(files)
    for directory, _, day in partitions:
        if day < border:
            files.delete(directory)
    young = F.col("ts") >= F.timestamp_seconds(F.lit(oldest))
    _rewrite(spark, path, files, [p for p in partitions if p[2] == border], young)


def delete_points(spark: SparkSession, path: str, start: int, stop: int, measurement: str | None = None) -> None:
    """Delete ``[start, stop]`` from the point store, of one measurement or of all. Days that go as a
    whole are not read; of the others, partitions without such points stay as they are."""
    files = FileTree(spark, path)
    doomed = F.col("ts").between(F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(stop)))
    if measurement is not None:
        doomed = doomed & (F.col("measurement") == measurement)
    epoch = date(1970, 1, 1).toordinal()
    some = []
    for directory, application, day in _partitions(files):
        first = (date.fromisoformat(day).toordinal() - epoch) * DAY
        if measurement is None and start <= first and first + DAY <= stop:
            files.delete(directory)
        elif first <= stop and start < first + DAY:
            some.append((directory, application, day))
    if some:
        hit = _with_rows(in_range(read_points(spark, path), start, stop + 1).where(doomed))
        some = [p for p in some if p[1:] in hit]
    _rewrite(spark, path, files, some, ~F.coalesce(doomed, F.lit(False)))


CSV_KEYS = ("Timestamp", "ems_time")
NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # the directory of a missing key


def export_metric_csv(points: DataFrame, path: str) -> None:
    """Raw points as one file per instance and metric, in order of time, with the header
    ``Timestamp,ems_time,<metric>``; ``None`` stands for a missing value.

    A file begins with its header and is one task's, which streams through it: the layout knows one
    file per series. Keys must not be missing for the sort of the window to be that of the writer, so
    missing ones are named like their directory."""
    keys = [F.coalesce(F.col(k), F.lit(NO_KEY)).alias(k) for k in SERIES]
    seconds = F.unix_seconds("ts")
    line = F.to_csv(F.struct(seconds.alias("a"), seconds.alias("b"), "value"), {"nullValue": "None"})
    rows = points.select(*keys, seconds.alias("at"), line.alias("line"))
    first = F.row_number().over(Window.partitionBy(*SERIES).orderBy("at", "line")) == 1
    head = F.concat(F.lit(",".join(CSV_KEYS) + ","), F.to_csv(F.struct("metric")), F.lit("\n"))
    lines = rows.select(*SERIES, F.concat(F.when(first, head).otherwise(""), "line").alias("value"))
    lines.write.mode("overwrite").partitionBy(*SERIES).text(path)


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of :func:`export_metric_csv`: ``application, instance, metric, Timestamp, ems_time, value``.
    The metric is the name in the header of the file, whatever its directory is called. Raises if there
    is no file."""
    lines = spark.read.schema("value string, application string, instance string, metric string").text(path)
    lines = lines.withColumn("file", F.col("_metadata.file_path"))
    is_head = F.startswith("value", F.lit(",".join(CSV_KEYS) + ","))
    named = F.from_csv("value", "a string, b string, metric string")["metric"]
    heads = materialise(lines.where(is_head).select("file", named.alias("metric")), "csv-heads")
    if heads.isEmpty():
        raise ValueError(f"no rows in {path}")
    fields = F.from_csv("value", "Timestamp long, ems_time long, value double", {"nullValue": "None"})
    rows = lines.where(~is_head).select("application", "instance", "file", fields.alias("row"))
    return rows.join(heads, "file").select(*SERIES, "row.*")


def export_wide_csv(wide: DataFrame, metrics: Sequence[str], path: str) -> None:
    """The aligned frame with one column per metric, one directory per instance."""
    rows = wide.select(
        *INSTANCE, F.col("t").alias("Timestamp"), F.col("t").alias("ems_time"), *metrics
    )
    (
        rows.hint("rebalance", *INSTANCE)
        .write.mode("overwrite")
        .partitionBy(*INSTANCE)
        .option("header", True)
        .option("nullValue", "None")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A directory of exported CSV files. Raises if it holds no row."""
    fields = [*[(k, "long") for k in CSV_KEYS], *[(c, "double") for c in columns]]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    frame = (
        spark.read.schema(f"{schema}, application string, instance string")
        .option("header", True)
        .option("nullValue", "None")
        .csv(path)
    )
    if frame.isEmpty():
        raise ValueError(f"no rows in {path}")
    return frame
