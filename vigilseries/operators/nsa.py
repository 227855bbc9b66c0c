"""Negative selection: one multivariate model per instance.

A model is three tables keyed by ``application, instance``: ``params`` (dimension, self radius,
distance threshold), ``self_points`` (distinct normal vectors) and ``detectors`` (balls that hold no
normal vector). All random numbers are hashes of a seed, the same for every instance, so a run can
be repeated exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.functions.arrow import list_matrix, matrix_list
from vigilseries.functions.columns import INSTANCE, every_salt, hash_uniform, salt, vector_norm
from vigilseries.functions.quantiles import IN_MEMORY_ROWS, at_ranks, interpolated
from vigilseries.functions.storage import materialise
from vigilseries.operators.neighbours import (
    BLOCK,
    distinct_points,
    first_copies,
    k_nearest,
    nearest,
    squared_distances,
)

LEAF_ROWS = 40  # fixed value: rows per leaf at which the seed tree stops splitting
TREE_ROWS = 65_536  # rows of a node from which a task finishes the seed tree
RANDOM_CANDIDATE = 1_000_000_000  # candidates from here on are random, smaller ones are tree nodes


@dataclass(frozen=True)
class NsaModel:
    params: DataFrame
    self_points: DataFrame
    detectors: DataFrame


def params(points: DataFrame, percentage: float) -> DataFrame:
    """Dimension and self radius of every instance."""
    return (
        points.groupBy(*INSTANCE)
        .agg(F.max(F.size("vec")).alias("dim"))
        .withColumn("self_radius", F.sqrt(F.col("dim").cast("double")) * percentage)
    )


def self_points(labelled: DataFrame) -> DataFrame:
    """The normal points (label 0) of a frame with ``rid, label, vec``."""
    return labelled.where(F.col("label") == 0)


def threshold(
    once: DataFrame, percentile: float, max_points: int | None = None
) -> DataFrame:
    """Percentile of the distance to the second nearest normal point (the first is the point
    itself); a point with a copy has distance 0. Instances with a single point get no threshold.
    ``once`` lists the distinct normal points with their number of copies ``n``."""
    lonely = once.where(F.col("n") == 1).select(*INSTANCE, F.col("rid").alias("qid"), "vec")
    refs = once.withColumn("aux", F.lit(None).cast("double"))
    found = nearest(
        lonely, refs, max_queries=max_points, max_refs=max_points, skip_same=True
    ).select(*INSTANCE, "near", F.lit(1).cast("long").alias("n"))
    copies = once.where(F.col("n") > 1).select(*INSTANCE, F.lit(0.0).alias("near"), "n")
    weighted = found.where(F.col("near").isNotNull()).unionByName(copies)
    if max_points is not None and max_points <= IN_MEMORY_ROWS:
        return weighted.groupBy(*INSTANCE).agg(
            F.percentile("near", F.lit(percentile / 100), F.col("n")).alias("threshold")
        )
    weighted = materialise(weighted, "nearest-others")  # read several times, searched once
    return weighted_percentile(weighted, percentile / 100).withColumnRenamed("q", "threshold")


def weighted_percentile(weighted: DataFrame, p: float) -> DataFrame:
    """Exact percentile of ``near`` with ``n`` copies each, without ordering a group."""
    total = weighted.groupBy(*INSTANCE).agg((F.lit(p) * (F.sum("n") - 1)).alias("rank"))
    total = materialise(total, "percentile-ranks")
    ends = F.explode(F.array(
        F.struct(F.lit("lo").alias("i"), F.floor("rank").alias("at")),
        F.struct(F.lit("hi").alias("i"), F.ceil("rank").alias("at")),
    )).alias("e")
    ranks = total.select(*INSTANCE, ends).select(*INSTANCE, "e.i", F.col("e.at").alias("rank"))
    of = lambda i: F.max(F.when(F.col("i") == i, F.col("picked"))).alias(i)
    picked = at_ranks(weighted, INSTANCE, "near", ranks, "n").groupBy(*INSTANCE).agg(of("lo"), of("hi"))
    return picked.join(total, [*INSTANCE]).select(
        *INSTANCE, interpolated("lo", "hi", F.col("rank")).alias("q")
    )


# --- candidate centres ------------------------------------------------------------------------


def tree_levels(n: int) -> int:
    """Levels of a binary space partition of ``n`` points."""
    return int(math.log2(max(1.0, (n - 1) / LEAF_ROWS)) + 1)


def _tree_nodes(
    x: np.ndarray, rid: np.ndarray, mode: str, root: int = 0, levels: int | None = None
) -> list[tuple[int, np.ndarray]]:
    """(node, lower corner or centroid) of a median-split tree, halves by the widest dimension; of
    the part below ``root``, if that is not the root of a tree with so many ``levels``."""
    inner = 2 ** ((tree_levels(len(x)) if levels is None else levels) - 1) - 1
    nodes, todo = [], [(root, np.arange(len(x)))]
    for node, rows in todo:
        low = x[rows].min(axis=0)
        nodes.append((node, low if mode == "corners" else x[rows].mean(axis=0)))
        if node < inner and len(rows) > 1:
            widest = int(np.argmax(x[rows].max(axis=0) - low))
            by_value = rows[np.lexsort((rid[rows], x[rows, widest]))]
            half = len(rows) // 2
            todo += [(2 * node + 1, by_value[:half]), (2 * node + 2, by_value[half:])]
    return nodes


def seeds(selves: DataFrame, mode: str, max_points: int | None = None) -> DataFrame:
    """Data-driven candidates ``cand, centre``: one per node of a median-split tree over the normal
    points of an instance, equal centres once (the first node keeps it)."""
    if mode not in ("corners", "centroids"):
        raise ValueError(f"unknown seed mode {mode!r}")
    if max_points is not None and max_points <= IN_MEMORY_ROWS:
        nodes = selves.select(*INSTANCE, "rid", "vec").groupBy(*INSTANCE).applyInArrow(
            _seed_task(mode),
            "application string, instance string, cand long, centre array<double>",
        )
    else:
        nodes = _seeds_by_level(selves, mode)
    return nodes.groupBy(*INSTANCE, "centre").agg(F.min("cand").alias("cand"))


def _seed_task(mode: str, below: bool = False):
    """Nodes of an instance, or of what is ``below`` a node of its tree."""

    def compute(table: pa.Table) -> pa.Table:
        place = [table[c][0].as_py() for c in ("node", "levels")] if below else []
        nodes = _tree_nodes(list_matrix(table["vec"]), table["rid"].to_numpy(), mode, *place)
        key = [table[c][0].as_py() for c in INSTANCE]
        return pa.table(
            {
                "application": pa.array([key[0]] * len(nodes), pa.string()),
                "instance": pa.array([key[1]] * len(nodes), pa.string()),
                "cand": pa.array([n for n, _ in nodes], pa.int64()),
                "centre": matrix_list(np.array([c for _, c in nodes])),
            }
        )

    return compute


def _seeds_by_level(selves: DataFrame, mode: str) -> DataFrame:
    """The same tree for instances that may be too large for one task. A level finds the value in the
    middle of every node and, where several points have it, the identifier in the middle of those; a
    point then knows its side by comparing. No node is ordered as a whole until its rows fit a task,
    which does what is below it. Identifiers are unique."""
    points = materialise(
        selves.select(*INSTANCE, "rid", "vec", F.lit(0).cast("long").alias("node")), "tree"
    )
    sizes = points.groupBy(*INSTANCE).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"))
    schema = "application string, instance string, cand long, centre array<double>"
    fits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / max(1, min(TREE_ROWS, IN_MEMORY_ROWS))))).cast("long")
    largest = sizes.agg(F.max("n"), F.max("d"), F.max(fits)).first()
    if largest[0] is None:
        return selves.sparkSession.createDataFrame([], schema)
    depth, dim, last = tree_levels(largest[0]), largest[1], largest[2]
    per_instance = F.floor(
        F.log2(F.greatest(F.lit(1.0), (F.col("n") - 1) / LEAF_ROWS)) + 1
    ).cast("long")
    limits = materialise(sizes.select(*INSTANCE, per_instance.alias("levels"), fits.alias("fits")), "tree-limits")
    found = None
    for level in range(depth):
        rest = points.join(limits.where(F.col("fits") == level).select(*INSTANCE, "levels"), [*INSTANCE])
        done = rest.groupBy(*INSTANCE, "node").applyInArrow(_seed_task(mode, below=True), schema)
        found = done if found is None else found.unionByName(done)
        if level == last:
            break
        points = points.join(limits.where(F.col("fits") > level).select(*INSTANCE), [*INSTANCE])
        low = F.array(*[F.min(F.get("vec", F.lit(j))) for j in range(dim)])
        high = F.array(*[F.max(F.get("vec", F.lit(j))) for j in range(dim)])
        mean = F.array(*[F.avg(F.get("vec", F.lit(j))) for j in range(dim)])
        bounds = points.groupBy(*INSTANCE, "node").agg(
            F.count(F.lit(1)).alias("size"),
            low.alias("low"),
            high.alias("high"),
            mean.alias("mean"),
        )
        centre = F.col("low") if mode == "corners" else F.col("mean")
        known = lambda a: F.filter(a, lambda x: x.isNotNull())
        level_nodes = bounds.select(*INSTANCE, F.col("node").alias("cand"), known(centre).alias("centre"))
        found = found.unionByName(level_nodes)
        if level == depth - 1:
            break
        spread = F.zip_with("high", "low", lambda a, b: a - b)
        widest = F.array_position(known(spread), F.array_max(known(spread))).cast("int")
        split = bounds.select(*INSTANCE, "node", "size", widest.alias("axis")).join(
            limits.where(F.col("levels") > level + 1), [*INSTANCE]
        )
        node = [*INSTANCE, "node"]
        sided = materialise(
            points.join(split.where(F.col("size") > 1), node)
            .withColumn("value", F.element_at("vec", F.col("axis")))
            .withColumn("salt", salt(F.col("rid"))),
            f"tree-values-{level}",
        )
        half = F.floor(F.col("size") / 2).alias("rank")
        wanted = split.where(F.col("size") > 1).select(*node, half, F.lit(0).alias("i"))
        wanted = materialise(wanted, f"tree-ranks-{level}")
        middle = materialise(
            at_ranks(sided, node, "value", wanted).drop("i").join(wanted.drop("i"), node)
            .select(*node, "picked", (F.col("rank") - F.col("below")).alias("ties_left")),
            f"tree-middles-{level}",
        )
        met = sided.join(middle.withColumn("salt", every_salt()), [*node, "salt"])
        ties = met.where((F.col("value") == F.col("picked")) & (F.col("ties_left") > 0)).select(*node, "rid")
        tied = middle.where(F.col("ties_left") > 0).select(*node, F.col("ties_left").alias("rank"), F.lit(0).alias("i"))
        first_right = at_ranks(ties, node, "rid", tied).select(*node, F.col("picked").alias("rid_right"))
        told = middle.join(first_right, node, "left").withColumn("salt", every_salt())
        tie = (F.col("value") == F.col("picked")) & F.coalesce(F.col("rid") < F.col("rid_right"), F.lit(False))
        left = (F.col("value") < F.col("picked")) | tie
        child = F.when(left, 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        points = materialise(
            sided.join(told, [*node, "salt"]).select(*INSTANCE, "rid", "vec", child.alias("node")),
            f"tree-{level}",
        )
    return materialise(found, "tree-nodes")  # read by several stages


def random_units(spark: SparkSession, count: int, dim: int, seed: int) -> DataFrame:
    """``count`` points of the unit cube (``count * dim`` numbers, set by the configuration)."""
    coordinates = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: hash_uniform(F.lit(seed), F.lit("centre"), F.col("id"), j),
    )
    return spark.range(count).select("id", coordinates.alias("unit"))


def random_centres(params: DataFrame, cfg: DetectorConfig, max_dim: int) -> DataFrame:
    """Points uniform in ``[-r, 1 + r]`` per coordinate, the same draw scaled for every instance."""
    units = random_units(params.sparkSession, cfg.max_detectors, max_dim, cfg.seed)
    ids = F.sequence(F.lit(0).cast("long"), F.lit(cfg.max_detectors - 1).cast("long"))
    r = F.col("self_radius")
    return (
        params.select(*INSTANCE, "dim", "self_radius", F.explode(ids).alias("id"))
        .join(units, "id")
        .select(
            *INSTANCE,
            (F.col("id") + RANDOM_CANDIDATE).alias("cand"),
            F.transform(F.slice("unit", 1, F.col("dim")), lambda u: (1 + 2 * r) * u - r).alias(
                "centre"
            ),
        )
    )


def candidates(
    selves: DataFrame,
    params: DataFrame,
    cfg: DetectorConfig,
    max_dim: int,
    max_points: int | None = None,
) -> DataFrame:
    """Seeds first, then random centres."""
    drawn = random_centres(params, cfg, max_dim)
    if cfg.seed_mode == "none":
        return drawn
    return seeds(selves, cfg.seed_mode, max_points).select(*drawn.columns).unionByName(drawn)


# --- detectors --------------------------------------------------------------------------------


def measure(
    centres: DataFrame,
    once: DataFrame,
    params: DataFrame,
    max_centres: int | None = None,
    max_points: int | None = None,
) -> DataFrame:
    """Radius a centre could have: distance to the nearest (distinct) normal point minus the self
    radius."""
    carried = [c for c in centres.columns if c not in INSTANCE]
    queries = centres.select(
        *INSTANCE, F.struct(*carried).alias("qid"), F.col("centre").alias("vec")
    )
    refs = once.withColumn("aux", F.lit(None).cast("double"))
    found = nearest(queries, refs, max_queries=max_centres, max_refs=max_points)
    return found.join(params.select(*INSTANCE, "self_radius"), [*INSTANCE]).select(
        *INSTANCE, "qid.*", (F.col("near") - F.col("self_radius")).alias("radius")
    )


def accepted(measured: DataFrame) -> DataFrame:
    return measured.where(F.col("radius") > 0)


def walks(rejected: DataFrame, cfg: DetectorConfig, max_dim: int) -> DataFrame:
    """``cand, attempt, offset``: how far a candidate has moved after each attempt. The steps do not
    depend on the data, so one walk per candidate number serves the whole fleet."""
    pct = cfg.self_percentage
    step = 2 * pct * hash_uniform(
        F.lit(cfg.seed), F.lit("step"), F.col("cand"), F.col("attempt"), F.col("j")
    ) - F.lit(pct)
    so_far = Window.partitionBy("cand", "j").orderBy("attempt")
    moved = (
        rejected.select("cand")
        .distinct()
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(cfg.max_attempts))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max_dim - 1))))
        .withColumn("x", F.sum(step).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    )
    listed = F.array_sort(F.collect_list(F.struct("j", "x")))  # max_dim entries
    return moved.groupBy("cand", "attempt").agg(
        F.transform(listed, lambda e: e["x"]).alias("offset")
    )


def perturbed(rejected: DataFrame, cfg: DetectorConfig, max_dim: int) -> DataFrame:
    """Every rejected candidate at each of its later positions."""
    moved = F.transform("centre", lambda x, j: x + F.get("offset", j))
    # A candidate such as the root corner is rejected in many instances: they share its walk in parts.
    parted = rejected.withColumn("salt", salt(*[F.col(c) for c in INSTANCE]))
    offsets = walks(rejected, cfg, max_dim).withColumn("salt", every_salt())
    return parted.join(offsets, ["cand", "salt"]).select(
        *INSTANCE, "cand", "attempt", moved.alias("centre")
    )


def retry(
    rejected: DataFrame,
    once: DataFrame,
    params: DataFrame,
    cfg: DetectorConfig,
    max_dim: int,
    max_points: int | None = None,
) -> DataFrame:
    """First accepted later position of the rejected candidates."""
    moved = perturbed(rejected, cfg, max_dim)
    tested = accepted(measure(moved, once, params, None, max_points))
    first = F.min_by(F.struct("centre", "radius"), "attempt").alias("hit")
    return (
        tested.groupBy(*INSTANCE, "cand")
        .agg(first, F.min("attempt").alias("attempt"))
        .select(*INSTANCE, "cand", "attempt", "hit.centre", "hit.radius")
    )


def cap_detectors(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` detectors in candidate order."""
    order = Window.partitionBy(*INSTANCE).orderBy("cand")
    return (
        found.withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= limit)
        .select(*INSTANCE, (F.col("nth") - 1).alias("det_id"), "centre", "radius")
    )


def uniform_of(*parts: object) -> float:
    """:func:`hash_uniform` of plain values."""
    text = "|".join(map(str, parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


@lru_cache(maxsize=8)
def _unit_points(seed: int, count: int, dim: int) -> np.ndarray:
    return np.array([[uniform_of(seed, "centre", i, j) for j in range(dim)] for i in range(count)])


@lru_cache(maxsize=4096)
def _walk(seed: int, share: float, cand: int, attempts: int, dim: int) -> np.ndarray:
    """How far a candidate has moved after each attempt; one walk serves the whole fleet."""
    steps = [[2 * share * uniform_of(seed, "step", cand, a, j) - share for j in range(dim)] for a in range(1, attempts + 1)]
    return np.cumsum(np.array(steps).reshape(attempts, dim), axis=0)


def _nearest_of(centres: np.ndarray, points: np.ndarray) -> np.ndarray:
    size = max(1, 65_536 // len(points))
    parts = [squared_distances(centres[i : i + size], points).min(axis=1) for i in range(0, len(centres), size)]
    return np.sqrt(np.concatenate(parts)) if parts else np.zeros(0)


def _detector_task(cfg: DetectorConfig, max_dim: int):
    """All detectors of an instance: candidates in order, each moved until it fits."""

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, centres, radii = [], [], []
        if len(left) and len(right):
            x, r = list_matrix(left["vec"]), right["self_radius"][0].as_py()
            dim = x.shape[1]
            known: dict[bytes, tuple[int, np.ndarray]] = {}
            if cfg.seed_mode != "none":
                for node, centre in _tree_nodes(x, left["rid"].to_numpy(), cfg.seed_mode):
                    known.setdefault((centre + 0.0).tobytes(), (node, centre))
            units = _unit_points(cfg.seed, cfg.max_detectors, max_dim)[:, :dim]
            drawn = (1 + 2 * r) * units - r
            cand = [node for node, _ in known.values()] + [RANDOM_CANDIDATE + i for i in range(len(drawn))]
            at = np.concatenate([np.array([c for _, c in known.values()]).reshape(-1, dim), drawn])
            points = np.unique(x, axis=0)
            radius = _nearest_of(at, points) - r
            for attempt in range(cfg.max_attempts):
                rest = np.flatnonzero(radius <= 0)
                if not len(rest):
                    break
                walk = [_walk(cfg.seed, cfg.self_percentage, cand[i], cfg.max_attempts, max_dim)[attempt, :dim] for i in rest]
                moved = at[rest] + np.array(walk)
                tried = _nearest_of(moved, points) - r
                fits = tried > 0
                radius[rest[fits]] = tried[fits]
                at[rest[fits]] = moved[fits]
            chosen = np.flatnonzero(radius > 0)[: cfg.max_detectors]
            numbers, centres, radii = list(range(len(chosen))), at[chosen].tolist(), radius[chosen].tolist()
        key = [left[c][0].as_py() if len(left) else None for c in INSTANCE]
        return pa.table(
            {
                "application": pa.array([key[0]] * len(numbers), pa.string()),
                "instance": pa.array([key[1]] * len(numbers), pa.string()),
                "det_id": pa.array(numbers, pa.int32()),
                "centre": pa.array(centres, pa.list_(pa.float64())),
                "radius": pa.array(radii, pa.float64()),
            }
        )

    return compute


def detectors(
    selves: DataFrame,
    once: DataFrame,
    params: DataFrame,
    cfg: DetectorConfig,
    max_dim: int,
    max_points: int | None = None,
) -> DataFrame:
    """Candidates that fit at once or after some perturbation, at most ``max_detectors``. Where the
    points of an instance are known to fit one block they move once, and the instance's task draws and
    tests the candidates; no candidate is a row."""
    if max_points is not None and max_points <= BLOCK:
        keys = list(INSTANCE)
        return (
            selves.select(*keys, "rid", "vec").groupBy(*keys)
            .cogroup(params.select(*keys, "self_radius").groupBy(*keys))
            .applyInArrow(
                _detector_task(cfg, max_dim),
                "application string, instance string, det_id int, centre array<double>, radius double",
            )
        )
    drawn = candidates(selves, params, cfg, max_dim, max_points)
    bound = None if max_points is None else cfg.max_detectors + max_points
    tested = materialise(measure(drawn, once, params, bound, max_points), "candidates")
    at_once = accepted(tested)
    if cfg.max_attempts < 1:
        return cap_detectors(at_once, cfg.max_detectors)
    rejected = tested.where(F.col("radius") <= 0).drop("radius")
    later = retry(rejected, once, params, cfg, max_dim, max_points).drop("attempt")
    return cap_detectors(at_once.unionByName(later), cfg.max_detectors)


def train(
    vectors: DataFrame, cfg: DetectorConfig, max_dim: int, max_points: int | None = None
) -> NsaModel:
    """Model tables from training vectors (``t, vec``), all of them normal. Instances with a single
    vector get no model."""
    selves = vectors.select(*INSTANCE, F.col("t").alias("rid"), "vec")
    once = materialise(distinct_points(selves), "nsa-self")
    limits = threshold(once, cfg.nsa_percentile, max_points)
    known = materialise(
        params(selves, cfg.self_percentage).join(limits, [*INSTANCE]), "nsa-params"
    )
    found = detectors(selves, once, known, cfg, max_dim, max_points)
    return NsaModel(known, once, materialise(found, "nsa-detectors"))


# --- scoring ----------------------------------------------------------------------------------


def outside(vec: Column, dim: Column, self_radius: Column) -> Column:
    """Longer than the longest vector of the enlarged unit cube."""
    edge = 1 + self_radius
    return vector_norm(vec) > F.sqrt(dim * edge * edge)


def _balls(model: NsaModel) -> DataFrame:
    return model.detectors.select(
        *INSTANCE, F.col("det_id").cast("long").alias("rid"), F.col("centre").alias("vec"),
        F.col("radius").alias("aux"),
    )


def _balls_and_points(model: NsaModel) -> DataFrame:
    normal = model.self_points.select(
        *INSTANCE, "rid", "vec", F.lit(None).cast("double").alias("aux")
    )
    return normal.unionByName(_balls(model))


def _judgeable(queries: DataFrame, model: NsaModel) -> DataFrame:
    """Queries that have the model's dimension, with its parameters and the outer bound in ``qid``."""
    carried = queries.join(model.params, [*INSTANCE]).where(F.size("vec") == F.col("dim"))
    beyond = outside(F.col("vec"), F.col("dim"), F.col("self_radius"))
    bag = F.struct("qid", "dim", "self_radius", "threshold", beyond.alias("beyond"))
    return carried.select(*INSTANCE, bag.alias("qid"), "vec")


def match(
    queries: DataFrame,
    model: NsaModel,
    max_queries: int | None = None,
    max_points: int | None = None,
    max_detectors: int | None = None,
) -> DataFrame:
    """For every query (``qid, vec``): ``near`` (distance to the nearest normal point), ``hit``
    (inside a detector), ``beyond`` (outer bound) and the model's parameters. Queries whose vector
    does not have the model's dimension (a selected metric has no data) are left out."""
    known = max_points is not None and max_detectors is not None  # else the rows are counted
    max_refs = max_points + max_detectors if known else None
    found = nearest(
        _judgeable(queries, model),
        _balls_and_points(model),
        max_queries=max_queries,
        max_refs=max_refs,
    )
    return found.select(
        *INSTANCE,
        "qid.qid",
        "near",
        F.coalesce("hit", F.lit(False)).alias("hit"),
        "qid.beyond",
        "qid.self_radius",
        "qid.threshold",
    )


def score(
    vectors: DataFrame,
    model: NsaModel,
    cfg: DetectorConfig,
    keys: Sequence[str] = INSTANCE,
    max_queries: int | None = None,
    max_points: int | None = None,
) -> DataFrame:
    """``distance_score`` and ``anomaly_bit`` per step. All training labels are 0, so the vote of the
    nearest labelled points can never be anomalous and is not computed."""
    extra = [k for k in keys if k not in INSTANCE]
    queries = vectors.select(*INSTANCE, F.struct("t", *extra).alias("qid"), "vec")
    found = match(queries, model, max_queries, max_points, cfg.max_detectors)
    anomalous = F.col("hit") | F.col("beyond") | (F.col("near") >= F.col("threshold"))
    return found.select(
        *INSTANCE,
        *[F.col(f"qid.{k}").alias(k) for k in extra],
        "qid.t",
        F.col("near").alias("distance_score"),
        F.when(anomalous, F.lit(cfg.anomaly_bit_max)).otherwise(F.lit(0)).alias("anomaly_bit"),
    )


# --- labelled vectors -------------------------------------------------------------------------


def neighbours_of(
    queries: DataFrame,
    labelled: DataFrame,
    k: int,
    max_queries: int | None = None,
    max_points: int | None = None,
) -> DataFrame:
    """k nearest labelled points of every query."""
    refs = first_copies(labelled, k).select(
        *INSTANCE, "rid", "vec", F.col("label").cast("double").alias("aux")
    )
    return k_nearest(queries, refs, k, max_queries=max_queries, max_refs=max_points)


def vote(neighbours: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """Majority of the k nearest labels, ties anomalous; normal without a vote if the distances
    differ and the nearest point is normal and within the self radius. Missing if fewer than k
    labelled points exist."""
    tally = neighbours.groupBy(*INSTANCE, "qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("aux") == 1).alias("ones"),
        F.min("dist").alias("low"),
        F.max("dist").alias("high"),
        F.min_by("aux", "rank").alias("first_label"),
    )
    trusted = (
        (F.col("low") < F.col("high"))
        & (F.col("low") <= F.col("self_radius"))
        & (F.col("first_label") == 0)
    )
    majority = F.col("ones") >= F.col("n") - F.col("ones")
    return tally.join(params.select(*INSTANCE, "self_radius"), [*INSTANCE]).select(
        *INSTANCE,
        "qid",
        F.when(F.col("n") >= k, ~trusted & majority).alias("vote"),
    )


def predict(
    queries: DataFrame,
    model: NsaModel,
    labelled: DataFrame,
    k: int,
    max_points: int | None = None,
) -> DataFrame:
    """Anomalous if inside a detector, beyond the outer bound or voted so."""
    found = match(queries, model, max_points, max_points)
    votes = vote(neighbours_of(queries, labelled, k, max_points, max_points), model.params, k)
    anomalous = F.col("hit") | F.col("beyond") | F.coalesce(F.col("vote"), F.lit(False))
    return found.join(votes, [*INSTANCE, "qid"], "left").select(
        *INSTANCE, "qid", F.col("near").alias("distance_score"), anomalous.alias("anomalous")
    )


def tuning_prediction(
    queries: DataFrame, model: NsaModel, max_points: int | None = None
) -> DataFrame:
    """Detectors and outer bound only: no query meets a normal point. Every model has a ball of radius
    0 besides, which holds nothing, so that a query without detectors has its row."""
    empty = model.params.select(
        *INSTANCE, F.lit(-1).cast("long").alias("rid"),
        F.array_repeat(F.lit(0.0), F.col("dim").cast("int")).alias("vec"), F.lit(0.0).alias("aux"),
    )
    found = nearest(
        _judgeable(queries, model), _balls(model).unionByName(empty), max_queries=max_points
    )
    return found.select(
        *INSTANCE, "qid.qid", "qid.self_radius", (F.col("hit") | F.col("qid.beyond")).alias("anomalous")
    )


def tune(
    model: NsaModel,
    labelled: DataFrame,
    sample: DataFrame,
    max_points: int | None = None,
) -> DataFrame:
    """Detectors after supervised tuning on ``sample`` (``rid, label, vec``).

    A wrongly flagged normal point removes the detectors whose centre is within the self radius; a
    missed anomaly adds a detector around itself that stays clear of all training points. Both sets
    are built from the model as it was, so the order of the sample does not matter.
    """
    points = sample.select(
        *INSTANCE, F.struct("rid", "label", "vec").alias("qid"), "vec"
    )
    judged = materialise(
        tuning_prediction(points, model, max_points).select(
            *INSTANCE, "self_radius", "anomalous", "qid.*"
        ),
        "judged",
    )
    none = F.lit(None).cast("double").alias("aux")
    false_alarms = judged.where((F.col("label") == 0) & F.col("anomalous"))
    centres = model.detectors.select(
        *INSTANCE, F.struct("det_id", "centre", "radius").alias("qid"), F.col("centre").alias("vec")
    )
    near_alarms = nearest(
        centres, false_alarms.select(*INSTANCE, "rid", "vec", none), max_queries=max_points,
        max_refs=max_points,
    ).join(model.params.select(*INSTANCE, "self_radius"), [*INSTANCE])
    removed = near_alarms.where(F.col("near") < F.col("self_radius")).select(
        *INSTANCE, "qid.det_id"
    )
    kept = model.detectors.join(removed, [*INSTANCE, "det_id"], "left_anti")
    missed = judged.where((F.col("label") == 1) & ~F.col("anomalous"))
    refs = distinct_points(labelled).select(*INSTANCE, "rid", "vec", none)
    around = nearest(
        missed.select(*INSTANCE, F.struct("rid", "vec", "self_radius").alias("qid"), "vec"),
        refs,
        max_queries=max_points,
        max_refs=max_points,
    )
    added = around.select(
        *INSTANCE,
        F.lit(None).cast("int").alias("det_id"),
        F.col("qid.vec").alias("centre"),
        (F.col("near") - F.col("qid.self_radius")).alias("radius"),
    ).where(F.col("radius") > 0)
    return kept.select(*added.columns).unionByName(added)
