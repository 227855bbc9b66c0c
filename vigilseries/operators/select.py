"""Which metrics of an instance the detectors use."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.arrow import list_matrix
from vigilseries.functions.columns import INSTANCE, SERIES
from vigilseries.functions.storage import materialise
from vigilseries.operators import forest
from vigilseries.operators.chunks import chunk_of, is_long

# Metrics per side of a correlation block: 2 x 256 series x one chunk stay near 40 MB.
METRIC_BLOCK = 256


def profile(aligned: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per metric: position, range, mean, population variance."""
    stats = aligned.groupBy(*SERIES).agg(
        F.count("value").alias("n"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.min("t").alias("lo"),
    )
    return stats.join(metrics.select(*SERIES, "ord"), [*SERIES])


def variable(stats: DataFrame) -> DataFrame:
    """Metrics with more than one distinct value."""
    return stats.where(F.col("vmin") < F.col("vmax"))


def varying_enough(stats: DataFrame, floor: float) -> DataFrame:
    return stats.where(F.col("variance") > floor)


def correlated(
    aligned: DataFrame, stats: DataFrame, cfg: DetectorConfig, steps: int | None = None
) -> DataFrame:
    """Metrics that correlate with an earlier one: ``metric, blocker, r`` (earliest blocker).

    Each series is packed per time chunk; blocks of series meet in a task that multiplies the two
    standardised blocks. With one chunk (the usual case) a task reports at most one row per metric;
    with several it reports partial sums per pair of metrics, never pairs of values.
    """
    long = is_long(cfg, steps)
    chunk = chunk_of(F.col("t"), cfg) if long else F.lit(0).cast("long")
    packed = (
        aligned.groupBy(*SERIES, chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("rows"))
        .select(*SERIES, "chunk", F.transform("rows", lambda r: r["value"]).alias("values"))
    )
    whole = Window.partitionBy(*INSTANCE)
    placed = stats.select(
        *SERIES,
        "ord",
        "n",
        "mean",
        F.sqrt("variance").alias("sd"),
        F.floor(F.col("ord") / METRIC_BLOCK).alias("block"),
        F.floor(F.max("ord").over(whole) / METRIC_BLOCK).alias("last_block"),
    )
    meetings = F.transform(
        F.sequence(F.lit(0).cast("long"), "last_block"),
        lambda other: F.struct(
            F.least("block", other).alias("a"), F.greatest("block", other).alias("b")
        ),
    )
    joined = packed.join(placed, [*SERIES]).select("*", F.explode(meetings).alias("pair"))
    groups = joined.select(
        *SERIES, "chunk", "ord", "n", "mean", "sd", "values", "block", "pair.a", "pair.b"
    ).groupBy(*INSTANCE, "a", "b", "chunk")
    limit = cfg.correlation_limit
    if long:
        sums = groups.applyInArrow(
            _partial_correlations,
            "application string, instance string, metric string, ord int, "
            "blocker string, blocker_ord int, part double",
        )
        pairs = (
            sums.groupBy(*INSTANCE, "metric", "ord", "blocker", "blocker_ord")
            .agg(F.sum("part").alias("r"))
            .where(F.abs("r") > limit)
        )
    else:
        pairs = groups.applyInArrow(
            _earliest_blocker(limit),
            "application string, instance string, metric string, ord int, "
            "blocker string, blocker_ord int, r double",
        )
    first = F.min_by(F.struct("blocker", "r"), "blocker_ord").alias("first")
    return pairs.groupBy(*SERIES).agg(first).select(*SERIES, "first.blocker", "first.r")


def _sides(table: pa.Table):
    """The two blocks of a meeting: positions, names and standardised rows (scaled by 1/sqrt n)."""
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    block = table["block"].to_numpy()
    ords, names = table["ord"].to_numpy(), np.array(table["metric"].to_pylist(), dtype=object)
    mean, sd, n = (table[c].to_numpy()[:, None] for c in ("mean", "sd", "n"))
    z = (list_matrix(table["values"]) - mean) / (sd * np.sqrt(n))
    return [(ords[block == side], names[block == side], z[block == side]) for side in (a, b)]


def _rows(table: pa.Table, value: str, later, earlier, number) -> pa.Table:
    """Result rows: (ord, name) of the later and of the earlier metric and a number."""
    count = len(number)
    return pa.table(
        {
            "application": pa.array([table["application"][0].as_py()] * count, pa.string()),
            "instance": pa.array([table["instance"][0].as_py()] * count, pa.string()),
            "metric": pa.array(list(later[1]), pa.string()),
            "ord": pa.array(later[0], pa.int32()),
            "blocker": pa.array(list(earlier[1]), pa.string()),
            "blocker_ord": pa.array(earlier[0], pa.int32()),
            value: pa.array(number, pa.float64()),
        }
    )


def _partial_correlations(table: pa.Table) -> pa.Table:
    (o1, m1, z1), (o2, m2, z2) = _sides(table)
    i, j = np.nonzero(o1[:, None] < o2[None, :])
    part = (z1 @ z2.T)[i, j]
    return _rows(table, "part", (o2[j], m2[j]), (o1[i], m1[i]), part)


def _earliest_blocker(limit: float):
    def compute(table: pa.Table) -> pa.Table:
        (o1, m1, z1), (o2, m2, z2) = _sides(table)
        by_ord = np.argsort(o1)
        o1, m1, z1 = o1[by_ord], m1[by_ord], z1[by_ord]
        if len(o1) == 0 or len(o2) == 0:
            i = j = np.array([], dtype=int)
            r = np.zeros((len(o1), len(o2)))
        else:
            r = z1 @ z2.T
            blocks = (np.abs(r) > limit) & (o1[:, None] < o2[None, :])
            j = np.nonzero(blocks.any(axis=0))[0]
            i = blocks[:, j].argmax(axis=0)
        return _rows(table, "r", (o2[j], m2[j]), (o1[i], m1[i]), r[i, j])

    return compute


def uncorrelated(stats: DataFrame, blocked: DataFrame) -> DataFrame:
    return stats.join(blocked.select(*SERIES), [*SERIES], "left_anti")


def importance(
    aligned: DataFrame, stats: DataFrame, cfg: DetectorConfig, steps: int | None = None
) -> DataFrame:
    """Share of the row number's variance that the equal-frequency bins of a metric explain,
    normalised per instance: a one-level regression on the same target the forest would get."""
    binned = (
        forest.binned(aligned, stats, cfg, steps)
        .groupBy(*SERIES, "bin")
        .agg(
            F.count("y").alias("c"),
            F.sum("y").alias("s"),
            F.sum(F.col("y") * F.col("y")).alias("ss"),
        )
    )
    n, s, ss = F.sum("c"), F.sum("s"), F.sum("ss")
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("c"))
    explained = binned.groupBy(*SERIES).agg((1 - within / (ss - s * s / n)).alias("raw"))
    total = F.sum("raw").over(Window.partitionBy(*INSTANCE))
    return explained.select(
        *SERIES, F.when(total != 0, F.col("raw") / total).otherwise(F.lit(0.0)).alias("importance")
    )


def top_n(stats: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` most important metrics, most important first; an instance with no more than ``n``
    metrics keeps them all in their original order. ``ord`` is renumbered."""
    whole = Window.partitionBy(*INSTANCE)
    ranked = stats.join(scores, [*SERIES], "left").withColumn(
        "key",
        F.when(F.count(F.lit(1)).over(whole) > n, -F.col("importance")).otherwise(F.lit(0.0)),
    )
    order = F.row_number().over(whole.orderBy("key", "ord"))
    return (
        ranked.withColumn("rank", order)
        .where(F.col("rank") <= n)
        .select(
            *SERIES,
            (F.col("rank") - 1).alias("ord"),
            "vmin",
            "vmax",
            F.col("importance"),
        )
    )


def crowded(stats: DataFrame, n: int) -> DataFrame:
    """Metrics of instances that have more than ``n`` of them."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*INSTANCE))
    return stats.withColumn("size", size).where(F.col("size") > n).drop("size")


def select_metrics(
    aligned: DataFrame, metrics: DataFrame, cfg: DetectorConfig, steps: int | None = None
) -> DataFrame:
    """Variability, variance, correlation and importance in turn; with the training range.

    The statistics (one row per metric) are written between the steps, so that the values are read
    once per step and correlations are computed once.
    """
    stats = materialise(
        varying_enough(variable(profile(aligned, metrics)), cfg.variance_floor), "profile"
    )
    kept = materialise(uncorrelated(stats, correlated(aligned, stats, cfg, steps)), "uncorrelated")
    weigh = {"bins": importance, "forest": forest.importance}[cfg.importance]
    scores = weigh(aligned, crowded(kept, cfg.top_n), cfg, steps)
    return top_n(kept, scores, cfg.top_n)
