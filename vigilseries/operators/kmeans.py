"""Two clusters per metric: one univariate model per instance and metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE, SERIES, euclidean, every_salt, salt
from vigilseries.functions.quantiles import IN_MEMORY_ROWS, bracketed_quantiles
from vigilseries.functions.storage import materialise
from vigilseries.operators.features import lag_columns


def two_means(x: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm, started at the point of smallest norm and the point farthest from it; an
    empty cluster keeps its centre."""
    c0 = x[np.argmin((x * x).sum(axis=1))]
    c1 = x[np.argmax(((x - c0) ** 2).sum(axis=1))]
    for _ in range(iterations):
        near0 = ((x - c0) ** 2).sum(axis=1) <= ((x - c1) ** 2).sum(axis=1)
        n0 = x[near0].mean(axis=0) if near0.any() else c0
        n1 = x[~near0].mean(axis=0) if not near0.all() else c1
        if np.array_equal(n0, c0) and np.array_equal(n1, c1):
            break
        c0, c1 = n0, n1
    return c0, c1


def _fit_task(columns: list[str], iterations: int):
    def compute(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = np.column_stack([table[c].to_numpy() for c in columns])
        c0, c1 = two_means(x, iterations)
        rows = {k: pa.array([table[k][0].as_py()], pa.string()) for k in SERIES}
        for name, centre in (("c0", c0), ("c1", c1)):
            rows[name] = pa.array([centre.tolist()], pa.list_(pa.float64()))
        return pa.table(rows)

    return compute


def fit(features: DataFrame, cfg: DetectorConfig, steps: int | None = None) -> DataFrame:
    """Centres ``c0, c1`` per metric.

    A series within the bound is one small task that runs all its iterations; the fleet's series
    run in parallel after a single shuffle. Longer series take the distributed iterations.
    """
    columns = lag_columns(cfg.kmeans_shape)
    rows = features.select(*SERIES, "t", *columns)
    if steps is not None and steps <= IN_MEMORY_ROWS:
        return rows.groupBy(*SERIES).applyInArrow(
            _fit_task(columns, cfg.kmeans_iterations),
            "application string, instance string, metric string, "
            "c0 array<double>, c1 array<double>",
        )
    return fit_distributed(rows, cfg)


def fit_distributed(features: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """The same algorithm for all models at once: every iteration is one aggregate of the series
    that still move, its small result a written table. A series ends when no row changes its
    cluster; a long one meets its centres in several tasks, with partial sums before the shuffle."""
    columns = lag_columns(cfg.kmeans_shape)
    rows = features.select(*SERIES, "t", *columns).withColumn("salt", salt(F.col("t")))
    rows = materialise(rows, "kmeans-features")
    point = F.array(*columns)
    norm = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    smallest = rows.groupBy(*SERIES).agg(F.min_by(point, F.struct(norm, F.col("t"))).alias("c0"))
    away = _squared(columns, "c0")
    none = F.lit(None).cast("array<double>")
    moving = materialise(
        rows.join(smallest.withColumn("salt", every_salt()), [*SERIES, "salt"])
        .groupBy(*SERIES)
        .agg(F.first("c0").alias("c0"), F.max_by(point, F.struct(away, -F.col("t"))).alias("c1"))
        .select(*SERIES, "c0", "c1", none.alias("p0"), none.alias("p1")),
        "kmeans-centres",
    )
    done = []
    for _ in range(cfg.kmeans_iterations):
        joined = rows.join(moving.withColumn("salt", every_salt()), [*SERIES, "salt"])
        near0 = _squared(columns, "c0") <= _squared(columns, "c1")
        before = _squared(columns, "p0") <= _squared(columns, "p1")
        mean0 = [F.avg(F.when(near0, F.col(c))) for c in columns]
        mean1 = [F.avg(F.when(~near0, F.col(c))) for c in columns]
        old0, old1 = F.first("c0"), F.first("c1")
        still = F.coalesce(F.bool_and(near0.eqNullSafe(before)), F.lit(False))
        moved = joined.groupBy(*SERIES).agg(
            F.when(still, old0)
            .otherwise(F.array(*[F.coalesce(m, old0[i]) for i, m in enumerate(mean0)]))
            .alias("c0"),
            F.when(still, old1)
            .otherwise(F.array(*[F.coalesce(m, old1[i]) for i, m in enumerate(mean1)]))
            .alias("c1"),
            old0.alias("p0"),
            old1.alias("p1"),
            still.alias("still"),
        )
        table = materialise(moved, "kmeans-centres")
        done.append(table.where("still").select(*SERIES, "c0", "c1"))
        moving = table.where(~F.col("still")).drop("still")
        if moving.isEmpty():
            break
    centres = moving.select(*SERIES, "c0", "c1")
    for part in done:
        centres = centres.unionByName(part)
    return centres


def _squared(columns: Sequence[str], centre: str) -> Column:
    parts = [(F.col(c) - F.col(centre)[i]) for i, c in enumerate(columns)]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def raw_score(columns: Sequence[str]) -> Column:
    """Sum of the distances to both centres."""
    own = [F.col(c) for c in columns]
    return euclidean(own, [F.col("c0")[i] for i in range(len(own))]) + euclidean(
        own, [F.col("c1")[i] for i in range(len(own))]
    )


def raw_scores(features: DataFrame, centres: DataFrame, cfg: DetectorConfig) -> DataFrame:
    columns = lag_columns(cfg.kmeans_shape)
    return features.join(centres, [*SERIES]).withColumn("raw", raw_score(columns))


def score_range(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*SERIES).agg(F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"))


def normalised(raw: Column, low: Column, high: Column) -> Column:
    """Position in the training range, not clipped; 0 where the range is empty."""
    return F.when(high == low, F.lit(0.0)).otherwise((raw - low) / (high - low))


def thresholds(scored: DataFrame, percentile: float, steps: int | None = None) -> DataFrame:
    """Range and percentile of the normalised training scores; 1 where the range is empty.

    Normalising keeps the order, so the percentile is taken from the raw scores.
    """
    width = F.col("raw_max") - F.col("raw_min")
    level = F.when(width > 0, (F.col("cut") - F.col("raw_min")) / width).otherwise(F.lit(1.0))
    p = percentile / 100
    if steps is not None and steps <= IN_MEMORY_ROWS:
        limits = scored.groupBy(*SERIES).agg(
            F.min("raw").alias("raw_min"),
            F.max("raw").alias("raw_max"),
            F.percentile("raw", F.lit(p)).alias("cut"),
        )
    else:
        cut = bracketed_quantiles(scored, SERIES, "raw", [p], "cuts")
        limits = score_range(scored).join(cut, [*SERIES]).withColumn("cut", F.col("cuts")[0])
    return limits.select(*SERIES, "raw_min", "raw_max", level.alias("threshold"))


def train(features: DataFrame, cfg: DetectorConfig, steps: int | None = None) -> DataFrame:
    """Model table: centres, score range and threshold per metric."""
    centres = fit(features, cfg, steps)
    scored = raw_scores(features, centres, cfg)
    limits = thresholds(scored.select(*SERIES, "raw"), cfg.kmeans_percentile, steps)
    return centres.join(limits, [*SERIES])


def score(
    features: DataFrame, models: DataFrame, cfg: DetectorConfig, keys: Sequence[str] = INSTANCE
) -> DataFrame:
    """``anomaly_score`` and ``anomaly_bit`` per metric and step."""
    scored = raw_scores(features, models, cfg).withColumn(
        "anomaly_score", normalised(F.col("raw"), F.col("raw_min"), F.col("raw_max"))
    )
    limit = F.coalesce(F.col("threshold"), F.lit(cfg.kmeans_fixed_threshold))
    bit = F.when(F.col("anomaly_score") >= limit, F.lit(cfg.anomaly_bit_max)).otherwise(F.lit(0))
    return scored.select(*keys, "metric", "t", "anomaly_score", bit.alias("anomaly_bit"))
