"""Bring the raw points of all metrics of an instance onto one regular time grid.

Frames from here on are long and gridded: key columns, ``metric``, ``t`` (epoch second of the grid
step) and ``value``. ``keys`` is the instance key; streaming adds the window end to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE, epoch, grid_floor
from vigilseries.operators.chunks import CHUNK, chunk_of, is_long


def grid_means(
    points: DataFrame, freq: int, keys: Sequence[str] = INSTANCE, carried: Sequence[str] = ()
) -> DataFrame:
    """Mean of every metric per grid step, and the number of raw points behind it. Partial sums
    are built before the shuffle, so a series that holds most of the raw points still sends one row
    per step and task. ``carried`` columns depend on the metric and are kept."""
    return (
        points.withColumn("t", grid_floor(epoch(F.col("ts")), freq))
        .groupBy(*keys, "metric", *carried, "t")
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("records"))
    )


def spine_bounds(means: DataFrame, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """First and last grid step over all metrics of an instance."""
    return means.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def spine(means: DataFrame, freq: int, keys: Sequence[str] = INSTANCE) -> DataFrame:
    """Every grid step of an instance."""
    steps = F.sequence("lo", "hi", F.lit(freq).cast("long"))
    return spine_bounds(means, keys).select(*keys, F.explode(steps).alias("t"))


def _bounds_per_series(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The instance's bounds on every one of its metrics. Values can then meet their bounds on the
    series key they are already partitioned by, instead of gathering whole instances."""
    own = means.groupBy(*keys, "metric").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    whole = Window.partitionBy(*keys)
    return own.select(
        *keys, "metric", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi")
    )


def _known_with_neighbours(
    means: DataFrame, cfg: DetectorConfig, keys: Sequence[str], steps: int | None
) -> DataFrame:
    """Known values of a series with the next known one (``next_t, next_value``), a flag for the
    first, and the instance's bounds ``lo, hi``. A metric that only ever reported missing values
    keeps one row without a value."""
    series = [*keys, "metric"]
    known = F.col("value").isNotNull()
    if not is_long(cfg, steps):
        # Missing values sort behind the known ones, so lead() finds the next known value.
        w = Window.partitionBy(*series).orderBy(F.col("value").isNull(), "t")
        rows = (
            means.select(
                "*",
                F.row_number().over(w).alias("nth"),
                F.lead("t").over(w).alias("lt"),
                F.lead("value").over(w).alias("next_value"),
            )
            .where(known | (F.col("nth") == 1))
            .select(
                *series,
                "t",
                "value",
                (F.col("nth") == 1).alias("first"),
                F.when(F.col("next_value").isNotNull(), F.col("lt")).alias("next_t"),
                "next_value",
            )
        )
        return rows.join(_bounds_per_series(means, keys), series)
    chunked = means.withColumn(CHUNK, chunk_of(F.col("t"), cfg))
    # One row per chunk links a chunk to the first known value after it and brings the bounds.
    whole = Window.partitionBy(*keys)
    w_chunks = Window.partitionBy(*series).orderBy(F.col("head").isNull(), CHUNK)
    links = (
        chunked.groupBy(*series, CHUNK)
        .agg(
            F.min(F.when(known, F.struct("t", "value"))).alias("head"),
            F.min("t").alias("lo"),
            F.max("t").alias("hi"),
        )
        .select(
            *series,
            CHUNK,
            F.min("lo").over(whole).alias("lo"),
            F.max("hi").over(whole).alias("hi"),
            (F.row_number().over(w_chunks) == 1).alias("first_chunk"),
            F.lead("head").over(w_chunks).alias("next_head"),
        )
    )
    w = Window.partitionBy(*series, CHUNK).orderBy(F.col("value").isNull(), "t")
    rows = chunked.select(
        "*",
        F.row_number().over(w).alias("nth"),
        F.lead("t").over(w).alias("lt"),
        F.lead("value").over(w).alias("lv"),
    ).join(links, [*series, CHUNK])
    first = (F.col("nth") == 1) & F.col("first_chunk")
    within = F.col("lv").isNotNull()
    return rows.where(known | first).select(
        *series,
        "t",
        "value",
        first.alias("first"),
        F.when(within, F.col("lt")).otherwise(F.col("next_head.t")).alias("next_t"),
        F.when(within, F.col("lv")).otherwise(F.col("next_head.value")).alias("next_value"),
        "lo",
        "hi",
    )


def _filled_grid(
    means: DataFrame, cfg: DetectorConfig, keys: Sequence[str], steps: int | None
) -> DataFrame:
    """Every (metric, grid step) once: each known value emits the steps up to the next one.

    This replaces the join of all metrics with all steps: the grid is generated from the sparse
    rows and never shuffled.
    """
    freq = F.lit(cfg.freq).cast("long")
    known = _known_with_neighbours(means, cfg, keys, steps)
    start = F.when(F.col("first"), F.col("lo")).otherwise(F.col("t"))
    stop = F.coalesce(F.col("next_t") - freq, F.col("hi"))
    return known.select("*", F.explode(F.sequence(start, stop, freq)).alias("step"))


def _interpolated():
    """Linear between known values, held after the last, missing before the first."""
    ahead = (F.col("step") - F.col("t")) / (F.col("next_t") - F.col("t"))
    rise = (F.col("next_value") - F.col("value")) * ahead
    return F.when(F.col("step") >= F.col("t"), F.col("value") + F.coalesce(rise, F.lit(0.0)))


def reindex(
    means: DataFrame,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    steps: int | None = None,
) -> DataFrame:
    """Every metric on every step of the instance, gaps without a value."""
    return _filled_grid(means, cfg, keys, steps).select(
        *keys,
        "metric",
        F.col("step").alias("t"),
        F.when(F.col("step") == F.col("t"), F.col("value")).alias("value"),
    )


def interpolate(
    means: DataFrame,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    steps: int | None = None,
) -> DataFrame:
    """Reindexed and interpolated; steps before the first known value stay missing."""
    return _filled_grid(means, cfg, keys, steps).select(
        *keys, "metric", F.col("step").alias("t"), _interpolated().alias("value")
    )


def zero_fill(frame: DataFrame) -> DataFrame:
    return frame.withColumn("value", F.coalesce("value", F.lit(0.0)))


def align(
    points: DataFrame,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    steps: int | None = None,
) -> DataFrame:
    """Raw points to a gap-free grid: floor, mean, common spine, interpolate, zero-fill."""
    return align_means(grid_means(points, cfg.freq, keys), cfg, keys, steps)


def align_means(
    means: DataFrame,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    steps: int | None = None,
) -> DataFrame:
    return zero_fill(interpolate(means, cfg, keys, steps))


def resample(frame: DataFrame, cfg: DetectorConfig, steps: int | None = None) -> DataFrame:
    """A second pass over a frame that is already keyed by epoch second ``t``."""
    points = frame.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    return align(points, cfg, steps=steps)


def pivot_wide(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One column per metric, one row per instance and step: the CSV layout."""
    return frame.groupBy(*INSTANCE, "t").pivot("metric", list(metrics)).agg(F.first("value"))


def wide_to_long(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Drop the duplicate time column and turn metric columns into rows."""
    return (
        wide.drop("Timestamp")
        .withColumn("t", F.col("ems_time").cast("long"))
        .unpivot([*INSTANCE, "t"], list(metrics), "metric", "value")
    )


def outer_scores(values: DataFrame, scores: DataFrame, on: Sequence[str]) -> DataFrame:
    """Values and scores side by side; a step missing on one side stays."""
    return values.join(scores, list(on), "full")


def complete_scores(
    values: DataFrame, scores: DataFrame, on: Sequence[str], required: Sequence[str]
) -> DataFrame:
    """Only steps where nothing is missing. One explicit test per column: the planner then turns
    the outer join into an inner join by itself."""
    kept = outer_scores(values, scores, on)
    for name in required:
        kept = kept.where(F.col(name).isNotNull())
    return kept
