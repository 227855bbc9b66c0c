"""Continuous detection with Structured Streaming.

Points become grid means (a tumbling window), grid means become overlapping scoring windows (a
sliding window over the first one), and every closed scoring window goes through the batch
functions with its end added to the key. Points later than the watermark are dropped from windows
that are already closed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE, SERIES
from vigilseries.functions.storage import stage_scope
from vigilseries.operators import detect
from vigilseries.operators.align import align_means
from vigilseries.plans import cycles, pipeline
from vigilseries.sources import control

WINDOW_KEYS = ("application", "instance", "window_end")


def grid_mean_stream(points: DataFrame, cfg: DetectorConfig, delay: str = "10 minutes") -> DataFrame:
    """Mean per metric and grid step. ``ts`` must be a timestamp with time zone."""
    return (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{cfg.freq} seconds").alias("step"), *SERIES)
        .agg(F.avg("value").alias("value"))
    )


def sliding_windows(means: DataFrame, cfg: DetectorConfig, slide_seconds: int) -> DataFrame:
    """Scoring windows: per metric the (at most window / step) grid means they cover."""
    span = F.window(
        F.window_time("step"), f"{cfg.score_seconds} seconds", f"{slide_seconds} seconds"
    )
    point = F.struct(F.unix_seconds(F.col("step.start")).alias("t"), F.col("value"))
    return means.groupBy(span.alias("span"), *SERIES).agg(F.collect_list(point).alias("points"))


def window_means(windows: DataFrame) -> DataFrame:
    """Scoring windows as grid means keyed by instance and window end."""
    return windows.select(
        *INSTANCE,
        F.unix_seconds("span.end").alias("window_end"),
        "metric",
        F.inline("points").alias("t", "value"),
    )


def score_windows(windows: DataFrame, models: pipeline.Models, cfg: DetectorConfig) -> DataFrame:
    """Rates of closed scoring windows: ``method, application, instance, window_end, metric``."""
    known = window_means(windows).join(models.gated.select(*SERIES), [*SERIES], "left_semi")
    aligned = align_means(known, cfg, WINDOW_KEYS, cfg.score_steps)
    columns = ["method", *WINDOW_KEYS, "metric", "rate", "window_start", "last_step"]
    whole, single = pipeline.scores(aligned, models, cfg, WINDOW_KEYS)
    found = []
    if whole is not None:
        rates = _rates(whole, WINDOW_KEYS, cfg)
        found.append(
            rates.withColumn("method", F.lit(cfg.nsa_method))
            .withColumn("metric", F.lit(None).cast("string"))
            .select(*columns)
        )
    if single is not None:
        rates = _rates(single, (*WINDOW_KEYS, "metric"), cfg)
        found.append(rates.withColumn("method", F.lit(cfg.kmeans_method)).select(*columns))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _rates(scores: DataFrame, keys: tuple[str, ...], cfg: DetectorConfig) -> DataFrame:
    return scores.groupBy(*keys).agg(
        (F.sum("anomaly_bit") * 100.0 / (F.count(F.lit(1)) * cfg.anomaly_bit_max)).alias("rate"),
        F.min("t").alias("window_start"),
        F.max("t").alias("last_step"),
    )


def window_detections(
    rates: DataFrame, models: pipeline.Models, cfg: DetectorConfig, margin: int | None = None
) -> DataFrame:
    """Detection rows of scored windows; a window is reported at its end. ``margin`` is what a batch
    was measured to need, else the configured one."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "metric")))
    names = models.selected.groupBy(*INSTANCE).agg(
        F.array_join(F.transform(listed, lambda m: m["metric"]), ",").alias("names")
    )
    nsa = F.col("method") == cfg.nsa_method
    limit = F.when(nsa, cfg.nsa_rate_limit).otherwise(cfg.kmeans_rate_limit)
    needed = F.lit(cfg.safety_margin if margin is None else margin)
    slot = detect.prediction_time(F.col("window_end"), cfg.horizon, needed)
    return rates.join(names, [*INSTANCE]).select(
        F.timestamp_seconds("window_end").alias("time"),
        detect.measurement_name(F.col("method"), F.col("instance"), F.col("metric")).alias(
            "measurement"
        ),
        F.col("application").alias("application_name"),
        F.col("instance").alias("node"),
        "method",
        F.when(nsa, F.col("names")).otherwise(F.col("metric")).alias("metrics"),
        F.lit(str(cfg.level)).alias("level"),
        F.col("rate").alias("metricValue"),
        (F.col("rate") >= limit).alias("anomaly"),
        slot.alias("predictionTime"),
        "window_start",
        F.col("last_step").alias("window_end"),
    )


def detection_sink(
    windows: DataFrame,
    load_models: Callable[[], pipeline.Models],
    cfg: DetectorConfig,
    detections_path: str,
    alerts_path: str,
    checkpoint: str,
    status: str | None = None,
) -> DataStreamWriter:
    """Every closed window is stored, flagged ones are also published as JSON messages. With a
    ``status`` folder the longest batch so far is the margin of the next ones.

    Models are loaded anew for every batch, so a retrain takes effect. A batch owns its directory
    and overwrites it when it is repeated after a failure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        models, begun, spark = load_models(), time.monotonic(), batch.sparkSession
        margin = cycles.margin(spark, status, cfg) if status else None
        stored = f"{detections_path}/batch={batch_id}"
        with stage_scope(batch.sparkSession):  # stage tables of the batch go once it is stored
            rows = window_detections(score_windows(batch, models, cfg), models, cfg, margin)
            rows.write.mode("overwrite").parquet(stored)
        kept = batch.sparkSession.read.schema(rows.schema).parquet(stored)
        now = F.unix_seconds("time")
        messages = detect.alerts_at(kept, now, cfg)
        messages.write.mode("overwrite").json(f"{alerts_path}/batch={batch_id}")
        if status:
            took = time.monotonic() - begun
            totals = kept.agg(F.max(now), F.count(F.lit(1)), F.count_if("anomaly")).first()
            if totals[0] is not None:  # a batch without a closed window tells nothing
                cycles.record(spark, status, totals[0], took, totals[1], totals[2])

    return windows.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    )


def registry_sink(
    messages: DataFrame, path: str, checkpoint: str, topic_prefix: str = ""
) -> DataStreamWriter:
    """Control messages appended to the registry's log, one directory per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = control.control_messages(batch, topic_prefix)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def table_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Closed windows as Parquet files."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
