"""Which metrics and instances take part."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.functions.columns import INSTANCE, SERIES
from vigilseries.functions.quantiles import grouped_quantiles
from vigilseries.functions.storage import materialise

# Up to this many values of an instance (all its metrics) one task filters them, column by column.
CELLS_IN_TASK = 2_000_000


def enough_records(points: DataFrame, min_records: int) -> DataFrame:
    """Metrics with strictly more raw points than ``min_records``, with their count."""
    return points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("records")).where(
        F.col("records") > min_records
    )


def gate_points(points: DataFrame, min_records: int) -> DataFrame:
    return points.join(enough_records(points, min_records).select(*SERIES), [*SERIES], "left_semi")


def missing_metrics(expected: DataFrame, points: DataFrame) -> DataFrame:
    """Expected metrics without a single point in the window."""
    return expected.select(*SERIES).join(
        points.select(*SERIES).distinct(), [*SERIES], "left_anti"
    )


def instances_without_data(instances: DataFrame, usable: DataFrame) -> DataFrame:
    """Discovered instances that have no usable metric left."""
    return instances.select(*INSTANCE).join(
        usable.select(*INSTANCE).distinct(), [*INSTANCE], "left_anti"
    )


def complete_instances(selected: DataFrame, points: DataFrame) -> DataFrame:
    """Instances where every selected metric has data in the scoring window."""
    present = points.select(*SERIES).distinct().withColumn("present", F.lit(1))
    counted = (
        selected.select(*SERIES)
        .join(present, [*SERIES], "left")
        .groupBy(*INSTANCE)
        .agg(F.count(F.lit(1)).alias("n_selected"), F.count("present").alias("n_present"))
    )
    return counted.where(F.col("n_selected") == F.col("n_present"))


def _inside(
    values: np.ndarray, counted: np.ndarray, shares: tuple[float, float], low: float | None, high: float | None
) -> np.ndarray | None:
    """Which values lie within the fences that the counted ones set (None: there are none), with the
    numbers of ``functions.quantiles`` and not-a-number above all numbers."""
    known = values[counted]
    if not len(known):
        return None
    ranks = [(len(known) - 1) * share for share in shares]
    near = [(int(np.floor(r)), int(np.ceil(r))) for r in ranks]
    placed = np.partition(known, sorted({i for pair in near for i in pair}))
    with np.errstate(invalid="ignore"):
        first, second = (
            placed[a] if a == b or placed[a] == placed[b] else (b - r) * placed[a] + (r - a) * placed[b]
            for r, (a, b) in zip(ranks, near, strict=True)
        )
        spread = second - first
        if spread == 0:
            return None
        bottom, top = first - 1.5 * spread, second + 1.5 * spread
        bottom = bottom if low is None else np.maximum(bottom, low)
        top = top if high is None else np.fmin(top, high)
        return ((values >= bottom) | np.isnan(values)) & ((values <= top) | np.isnan(top))


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are there."""
    known = column.is_valid().to_numpy()
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(), known


def _by_size(
    rows: DataFrame, keys: Sequence[str], bound: int | None, columns: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of the groups that fit a task, and those of the larger ones."""
    if bound is not None and bound * columns <= CELLS_IN_TASK:
        return rows, None
    counted = rows.groupBy(*keys).agg((F.count(F.lit(1)) * columns).alias("cells"))
    large = materialise(counted.where(F.col("cells") > CELLS_IN_TASK), "large-instances")
    if large.isEmpty():
        return rows, None
    return rows.join(large, [*keys], "left_anti"), rows.join(large.select(*keys), [*keys], "left_semi")


def drop_outlier_steps(
    aligned: DataFrame,
    metrics: DataFrame,
    lower_quantile: float = 0.10,
    upper_quantile: float = 0.90,
    steps: int | None = None,
) -> DataFrame:
    """The same filter on a gap-free long frame whose instances have different metrics, visited in
    the order of ``ord``. Returns the rows of the steps that are left.

    An instance of at most ``CELLS_IN_TASK`` values is filtered in one task after a single shuffle,
    whatever the number of metrics; larger ones go through tables by position. Both give the same."""
    last = metrics.agg(F.max("ord")).first()[0]
    if last is None:
        return aligned
    named = aligned.where(F.col("application").isNotNull() & F.col("instance").isNotNull())
    size = None if steps is None else steps * (last + 1)
    fitting, large = _by_size(named, INSTANCE, size, 1)
    shares = (lower_quantile, upper_quantile)

    def filtered(group: pa.Table) -> pa.Table:
        times, place = np.unique(group["t"].to_numpy(), return_inverse=True)
        alive = np.ones(len(times), dtype=bool)
        values, known = _numbers(group["value"])
        position = group["ord"].fill_null(-1).to_numpy()
        by_position = np.argsort(position, kind="stable")
        cuts = np.flatnonzero(np.diff(position[by_position])) + 1
        for rows in np.split(by_position, cuts):
            if position[rows[0]] >= 0:
                inside = _inside(values[rows], alive[place[rows]] & known[rows], shares, None, None)
                if inside is not None:
                    alive[place[rows[known[rows] & ~inside]]] = False
        return group.drop_columns(["ord"]).filter(pa.array(alive[place]))

    placed = fitting.join(metrics.select(*SERIES, "ord"), [*SERIES], "left").select(*aligned.columns, "ord")
    kept = placed.groupBy(*INSTANCE).applyInArrow(filtered, aligned.schema)
    if large is None:
        return kept
    return kept.unionByName(_drop_by_position(large, metrics, last, *shares, steps))


def _drop_by_position(
    aligned: DataFrame, metrics: DataFrame, last: int, lower_quantile: float, upper_quantile: float, steps: int | None
) -> DataFrame:
    """All instances at once, one position (``ord``) after the other: only the steps still alive are
    carried from one to the next."""
    placed = aligned.join(metrics.select(*SERIES, "ord"), [*SERIES])
    alive = materialise(aligned.select(*INSTANCE, "t").distinct(), "alive")
    for position in range(last + 1):
        column = placed.where(F.col("ord") == position).join(alive, [*INSTANCE, "t"], "left_semi")
        column = materialise(column.select(*INSTANCE, "t", "value"), "column")
        fences = grouped_quantiles(
            column, INSTANCE, "value", [lower_quantile, upper_quantile], steps, "_q"
        )
        spread = F.col("_q")[1] - F.col("_q")[0]
        inside = F.col("value").between(
            F.col("_q")[0] - 1.5 * spread, F.col("_q")[1] + 1.5 * spread
        )
        outliers = column.join(fences, [*INSTANCE]).where((spread != 0) & ~inside)
        alive = materialise(
            alive.join(outliers.select(*INSTANCE, "t"), [*INSTANCE, "t"], "left_anti"), "alive"
        )
    return aligned.join(alive, [*INSTANCE, "t"], "left_semi")


def remove_outliers_iqr(
    wide: DataFrame,
    columns: Sequence[str],
    lower: Mapping[str, float] | None = None,
    upper: Mapping[str, float] | None = None,
    lower_quantile: float = 0.10,
    upper_quantile: float = 0.90,
    keys: Sequence[str] = INSTANCE,
    rows_per_key: int | None = None,
) -> DataFrame:
    """Keep rows inside the inter-quantile fences of every column, one column after the other.

    The quantiles of a column are taken from the rows the earlier columns left over. A column
    without quantiles or without spread is skipped together with its manual bounds. In the end no
    column may be missing. Rows without a key are not compared with any fences.

    A key of at most ``CELLS_IN_TASK`` values (``rows_per_key``: a known bound of its rows) is filtered
    in one task after a single shuffle; larger ones go through a table per column. Both give the same.
    """
    columns, shares = list(columns), (lower_quantile, upper_quantile)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))
    keyless = reduce(or_, [F.col(k).isNull() for k in keys])
    if rows_per_key is None:
        wide = materialise(wide, "outliers")  # counted, then filtered
    fitting, large = _by_size(wide.where(~keyless), keys, rows_per_key, max(len(columns), 1))
    kept = fitting.groupBy(*keys).applyInArrow(
        _fenced(columns, shares, dict(lower or {}), dict(upper or {})), wide.schema
    )
    kept = kept.unionByName(wide.where(keyless & whole))
    if large is None:
        return kept
    rest = _by_column(large, columns, lower, upper, shares, keys, rows_per_key)
    return kept.unionByName(rest.where(whole))


def _fenced(
    columns: list[str], shares: tuple[float, float], lower: dict[str, float], upper: dict[str, float]
) -> Callable[[pa.Table], pa.Table]:
    def filtered(group: pa.Table) -> pa.Table:
        alive, complete = np.ones(len(group), dtype=bool), np.ones(len(group), dtype=bool)
        for name in columns:
            values, known = _numbers(group[name])
            inside = _inside(values, alive & known, shares, lower.get(name), upper.get(name))
            complete &= known
            if inside is not None:
                alive &= inside & known
        return group.filter(pa.array(alive & complete))

    return filtered


def _by_column(
    wide: DataFrame,
    columns: Sequence[str],
    lower: Mapping[str, float] | None,
    upper: Mapping[str, float] | None,
    shares: tuple[float, float],
    keys: Sequence[str],
    rows_per_key: int | None,
) -> DataFrame:
    """What is left after a column is written once, since the next one reads it several times."""
    lower, upper = lower or {}, upper or {}
    for name in columns:
        wide = materialise(wide, "outliers")
        fences = grouped_quantiles(
            wide, keys, name, list(shares), rows_per_key, "_q"
        )
        spread = F.col("_q")[1] - F.col("_q")[0]
        low, high = F.col("_q")[0] - 1.5 * spread, F.col("_q")[1] + 1.5 * spread
        if name in lower:
            low = F.greatest(low, F.lit(float(lower[name])))
        if name in upper:
            high = F.least(high, F.lit(float(upper[name])))
        inside = F.col(name).between(low, high)
        skipped = spread.isNull() | (spread == 0)
        wide = wide.join(fences, list(keys), "left").where(skipped | inside).drop("_q")
    return wide
