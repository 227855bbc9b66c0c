"""Importance of metrics by a forest of regression trees that predict the row number.

All trees of all instances grow together, level by level. A level is one aggregate over the rows, of
(instance, tree, node, metric, bin), combined before the shuffle; the best split of every node is then
chosen from running sums over its few bins. Rows are packed once, one per step with the bins of all
metrics and the number of times that each tree drew it; trees are small tables, a row walks through
them to its node, and nothing about a single row is ever written again.

Metrics enter as equal-frequency bins, so a tree does not depend on their scale. A tree draws a row
as often as a hash of its number and the row's says, with the frequencies of drawing with replacement
from a large set; runs repeat exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import INSTANCE, SERIES, hash_uniform, let
from vigilseries.functions.quantiles import grouped_quantiles
from vigilseries.functions.storage import materialise

# Chances to draw a row at most 0, 1, 2, ... times (Poisson with mean one).
DRAWN = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182)
LEAST_GAIN = 1e-6


def binned(
    aligned: DataFrame, stats: DataFrame, cfg: DetectorConfig, steps: int | None = None
) -> DataFrame:
    """``bin`` of every value among equal-frequency bins of its series, and the row number ``y``."""
    bins = cfg.importance_bins
    cuts = [k / bins for k in range(1, bins)]
    rows = aligned.join(stats.select(*SERIES, "lo"), [*SERIES])
    splitters = grouped_quantiles(rows, SERIES, "value", cuts, steps, "cuts")
    # number of cuts below the value, as plain comparisons
    bin_of = sum(
        ((F.col("value") > F.col("cuts")[i]).cast("int") for i in range(len(cuts))), F.lit(0)
    )
    y = ((F.col("t") - F.col("lo")) / cfg.freq).cast("double")
    return rows.join(splitters, [*SERIES]).select(*SERIES, "t", bin_of.alias("bin"), y.alias("y"))


def times_drawn(seed: int, tree: Column, y: Column) -> Column:
    u = hash_uniform(F.lit(seed), F.lit("tree"), tree, y.cast("long"))
    return let(u, lambda v: sum(((v >= x).cast("int") for x in DRAWN), F.lit(0)))


def _packed(bins: DataFrame, positions: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """One row per instance and step: bins in the order of ``pos``, draws in the order of trees."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "bin")))
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.forest_trees - 1)), lambda k: times_drawn(cfg.seed, k, F.col("y"))
    )
    rows = bins.join(positions.select(*SERIES, "pos"), [*SERIES]).groupBy(*INSTANCE, "y").agg(listed.alias("bins"))
    return rows.select(*INSTANCE, "y", F.transform("bins", lambda b: b["bin"]).alias("bins"), drawn.alias("drawn"))


def _model(grown: list[DataFrame], trees: int) -> DataFrame:
    """The splits of an instance as ``model[tree][node]``; node n has the children 2n and 2n + 1."""
    def dense(listed: Column, size: int) -> Column:
        known = F.map_from_entries(listed)
        return let(known, lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(m, i)))

    splits = reduce(DataFrame.unionByName, grown)
    nodes = dense(F.collect_list(F.struct("node", F.struct("pos", "bin"))), 1 << len(grown))
    of_tree = splits.groupBy(*INSTANCE, "tree").agg(nodes.alias("nodes"))
    return of_tree.groupBy(*INSTANCE).agg(dense(F.collect_list(F.struct("tree", "nodes")), trees).alias("model"))


def _at_node(depth: int, tree: Column) -> Column:
    """The node of a level that a row with ``bins`` comes to in a tree of ``model``; 0 if it ends
    before."""
    if depth == 0:
        return F.lit(1)

    def step(node: Column, _: Column) -> Column:
        split = F.get(F.get("model", tree), node)
        side = (F.get("bins", split["pos"]) > split["bin"]).cast("int")
        return F.when(split.isNull(), 0).otherwise(2 * node + side)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def _level(rows: DataFrame, grown: list[DataFrame], cfg: DetectorConfig) -> DataFrame:
    """The best split of every node of the next level: ``tree, node, pos, bin, gain``. Ties go to the
    first metric and the lowest bin."""
    depth = len(grown)
    if grown:
        rows = rows.join(materialise(_model(grown, cfg.forest_trees), "forest-model"), [*INSTANCE])
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.forest_trees - 1)),
        lambda k: F.struct(k.alias("tree"), F.get("drawn", k).alias("n"), _at_node(depth, k).alias("node")),
    )
    open_ = F.filter(trees, lambda x: (x["n"] > 0) & (x["node"] > 0))
    each = rows.select(*INSTANCE, "y", "bins", F.explode(open_).alias("at"))
    sums = (
        each.select(*INSTANCE, "y", "at.*", F.posexplode("bins").alias("pos", "bin"))
        .groupBy(*INSTANCE, "tree", "node", "pos", "bin")
        .agg(F.sum("n").cast("double").alias("c"), F.sum(F.col("n") * F.col("y")).alias("s"))
    )
    of_metric = Window.partitionBy(*INSTANCE, "tree", "node", "pos")
    upto = of_metric.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    left_c, left_s = F.sum("c").over(upto), F.sum("s").over(upto)
    sides = sums.select(
        *INSTANCE, "tree", "node", "pos", "bin", left_c.alias("c1"), left_s.alias("s1"),
        F.sum("c").over(of_metric).alias("c"), F.sum("s").over(of_metric).alias("s"),
    ).where(F.col("c1") < F.col("c"))
    right_c, right_s = F.col("c") - F.col("c1"), F.col("s") - F.col("s1")
    gain = F.col("s1") * F.col("s1") / F.col("c1") + right_s * right_s / right_c - F.col("s") * F.col("s") / F.col("c")
    best = F.max_by(F.struct("pos", "bin", "gain"), F.struct("gain", -F.col("pos"), -F.col("bin")))
    return (
        sides.withColumn("gain", gain)
        .groupBy(*INSTANCE, "tree", "node")
        .agg(best.alias("best"))
        .select(*INSTANCE, "tree", "node", "best.*")
        .where(F.col("gain") > LEAST_GAIN)
    )


def importance(
    aligned: DataFrame, stats: DataFrame, cfg: DetectorConfig, steps: int | None = None
) -> DataFrame:
    """Each metric's share of what the splits of a tree explain, averaged over the trees and
    normalised per instance."""
    order = Window.partitionBy(*INSTANCE).orderBy("ord")
    positions = stats.withColumn("pos", F.row_number().over(order) - 1)
    rows = materialise(_packed(binned(aligned, stats, cfg, steps), positions, cfg), "forest-rows")
    grown: list[DataFrame] = []
    for _ in range(cfg.forest_depth):
        level = materialise(_level(rows, grown, cfg), "forest-level")
        if level.isEmpty():
            break
        grown.append(level)
    if not grown:
        return stats.select(*SERIES, F.lit(0.0).alias("importance"))
    gains = reduce(DataFrame.unionByName, grown).groupBy(*INSTANCE, "tree", "pos").agg(F.sum("gain").alias("gain"))
    of_tree = F.sum("gain").over(Window.partitionBy(*INSTANCE, "tree"))
    shares = gains.withColumn("share", F.col("gain") / of_tree).groupBy(*INSTANCE, "pos").agg(F.sum("share").alias("share"))
    whole = F.sum("share").over(Window.partitionBy(*INSTANCE))
    normed = shares.select(*INSTANCE, "pos", (F.col("share") / whole).alias("share"))
    return positions.select(*SERIES, "pos").join(normed, [*INSTANCE, "pos"], "left").select(
        *SERIES, F.coalesce("share", F.lit(0.0)).alias("importance")
    )
