"""Exact quantiles (linear interpolation) per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.functions.columns import every_salt, salt
from vigilseries.functions.storage import materialise

# Above this many rows per group the in-memory aggregate is replaced by the bracketing plan.
IN_MEMORY_ROWS = 200_000
SKETCH_ACCURACY = 10_000
BUCKETS = 100  # of a group whose values are searched for a rank


def interpolated(low: str, high: str, rank: Column) -> Column:
    """Between the values at the ranks below and above, with the operations of the built-in
    aggregate in their order, so that both give the same number."""
    below, above = rank - F.floor(rank), F.ceil(rank) - rank
    between = above * F.col(low) + below * F.col(high)
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(between)


def at_ranks(
    df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, weight: str | None = None
) -> DataFrame:
    """``keys, i, picked, below`` for the wanted ``ranks`` (``keys, i, rank``, counted from 0): the
    value at that rank of its group and the weight of all smaller values.

    Equal values are counted together first. A sketch cuts each group into buckets; their sums tell
    which one holds a rank, and only the values of that bucket are ordered, never a group."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    borders = rows.groupBy(*keys).agg(
        F.percentile_approx(value, [k / BUCKETS for k in range(1, BUCKETS)], 10 * BUCKETS).alias("_ends")
    )
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_m")
    )
    parted = counts.withColumn("_salt", salt(F.col("_v"))).join(
        borders.withColumn("_salt", every_salt()), [*keys, "_salt"]
    )
    bucket = F.size(F.filter("_ends", lambda x: x < F.col("_v")))
    cut = materialise(parted.select(*keys, "_v", "_m", bucket.alias("_bucket")), "ranked-values")
    order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum("_m").alias("_w"))  # a few rows per group
    starts = sums.withColumn("_start", F.sum("_w").over(order) - F.col("_w"))
    chosen = ranks.join(starts, keys).where(
        (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_w"))
    )
    inside = cut.join(chosen.select(*keys, "i", "rank", "_bucket", "_start"), [*keys, "_bucket"])
    order = Window.partitionBy(*keys, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum("_m").over(order)
    ranked = inside.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_m"))
    hit = ranked.where((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_upto")))
    return hit.select(*keys, "i", F.col("_v").alias("picked"), F.col("_below").alias("below"))


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    rows_per_key: int | None,
    name: str = "quantiles",
) -> DataFrame:
    """``keys`` and an array of exact quantiles of the non-missing values.

    ``rows_per_key`` is a known upper bound of the group size (None: unknown). Within the bound the
    built-in aggregate is used, which holds the values of a group in one task.
    """
    if rows_per_key is not None and rows_per_key <= IN_MEMORY_ROWS:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        return df.groupBy(*keys).agg(F.percentile(value, wanted).alias(name))
    return bracketed_quantiles(df, keys, value, probabilities, name)


def bracketed_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Exact quantiles without holding a group: a mergeable sketch gives a bracket around every
    wanted rank; rows below it are only counted, equal values inside it are counted together, and
    only the few distinct values of the bracket are ordered."""
    keys = list(keys)
    margin = 10.0 / SKETCH_ACCURACY
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = [
        end
        for p in probabilities
        for end in (max(p - margin, 0.0), min(p + margin, 1.0))
    ]
    sketch = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_ends"),
    )
    brackets = []
    for i, p in enumerate(probabilities):
        # In a small group the margin is less than a few ranks: bracket all of it.
        small = F.col("_n") < 10 / margin
        low, high = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        low = F.col("_min") if p - margin <= 0 else F.when(small, F.col("_min")).otherwise(low)
        high = F.col("_max") if p + margin >= 1 else F.when(small, F.col("_max")).otherwise(high)
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        brackets.append(
            F.struct(
                F.lit(i).alias("i"), low.alias("low"), high.alias("high"), rank.alias("rank")
            )
        )
    wanted = sketch.select(*keys, F.explode(F.array(*brackets)).alias("_b"))
    # Equal values are counted first; a large group then meets its brackets in several tasks.
    parted = (
        known.groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_salt", salt(F.col("_v")))
    )
    inside = F.when(F.col("_v") >= F.col("_b.low"), F.col("_v"))
    counts = (
        parted.join(wanted.withColumn("_salt", every_salt()), [*keys, "_salt"])
        .where(F.col("_v") <= F.col("_b.high"))
        .groupBy(*keys, "_b", inside.alias("_w"))
        .agg(F.sum("_m").alias("_c"))
    )
    order = Window.partitionBy(*keys, "_b").orderBy(F.col("_w").asc_nulls_first())
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, "_b", "_w", upto.alias("_upto"), "_c")
    below, above = F.floor("_b.rank"), F.ceil("_b.rank")
    hit = lambda rank: F.max(
        F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col("_w"))
    )
    picked = ranked.groupBy(*keys, "_b").agg(hit(below).alias("_lo"), hit(above).alias("_hi"))
    quantile = interpolated("_lo", "_hi", F.col("_b.rank"))
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col("_b.i").alias("i"), quantile.alias("q")))
    )
    return picked.groupBy(*keys).agg(F.transform(ordered, lambda x: x["q"]).alias(name))
