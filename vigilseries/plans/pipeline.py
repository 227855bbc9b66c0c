"""The whole run for a fleet: points to models, points and models to detections."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig, FeatureShape
from vigilseries.functions.columns import INSTANCE, SERIES
from vigilseries.functions.storage import materialise
from vigilseries.operators import detect, features, gates, kmeans, nsa, select
from vigilseries.operators.align import align_means, grid_means
from vigilseries.sources import points as source


@dataclass(frozen=True)
class Models:
    """Everything scoring needs. ``gated`` lists the metrics that passed the records gate."""

    gated: DataFrame
    selected: DataFrame
    nsa: nsa.NsaModel | None
    kmeans: DataFrame | None


class TrainingRun:
    """Stages of a training run, each built when first used. A stage that feeds several later ones
    is a written table, so raw points are scanned once and no stage is computed twice."""

    def __init__(self, points: DataFrame, now: int, cfg: DetectorConfig):
        self.points, self.now, self.cfg = points, now, cfg

    @cached_property
    def series_points(self) -> DataFrame:
        inside = source.training_range(self.points, self.now, self.cfg)
        return source.series_points(inside, self.cfg.metric_prefix)

    @cached_property
    def means(self) -> DataFrame:
        """Grid means of all metrics with their record counts."""
        return materialise(
            grid_means(self.series_points, self.cfg.freq, carried=("measurement", "destination")),
            "means",
        )

    @cached_property
    def gated(self) -> DataFrame:
        """Metrics with enough raw points, in order."""
        counted = self.means.groupBy(*SERIES, "measurement", "destination").agg(
            F.sum("records").alias("records")
        )
        enough = counted.where(F.col("records") > self.cfg.min_records)
        return materialise(source.numbered(enough), "gated")

    @cached_property
    def aligned(self) -> DataFrame:
        usable = self.means.join(self.gated.select(*SERIES), [*SERIES], "left_semi")
        frame = materialise(align_means(usable, self.cfg, steps=self.cfg.train_steps), "aligned")
        return materialise(self._cleaned(frame), "cleaned") if self.cfg.iqr_filter else frame

    def _cleaned(self, frame: DataFrame) -> DataFrame:
        """The optional outlier filter: steps it drops are interpolated again."""
        cfg = self.cfg
        kept = gates.drop_outlier_steps(
            frame, self.gated, cfg.lower_quantile, cfg.upper_quantile, cfg.train_steps
        )
        return align_means(kept, cfg, steps=cfg.train_steps)

    @cached_property
    def stats(self) -> DataFrame:
        return select.profile(self.aligned, self.gated)

    @cached_property
    def selected(self) -> DataFrame:
        chosen = select.select_metrics(self.aligned, self.gated, self.cfg, self.cfg.train_steps)
        return materialise(chosen, "selected")

    @cached_property
    def scaled(self) -> DataFrame:
        return features.minmax_transform(self.aligned, self.selected)

    @cached_property
    def _shaped(self) -> dict[FeatureShape, DataFrame]:
        return {}

    def features(self, shape: FeatureShape) -> DataFrame:
        if shape not in self._shaped:
            rows = features.featurise(self.scaled, shape, self.cfg, steps=self.cfg.train_steps)
            self._shaped[shape] = materialise(rows, "features")
        return self._shaped[shape]

    @cached_property
    def vectors(self) -> DataFrame:
        shape = self.cfg.nsa_shape
        return materialise(features.vectors(self.features(shape), shape), "vectors")

    @property
    def max_dim(self) -> int:
        return self.cfg.top_n * self.cfg.nsa_shape.width

    @cached_property
    def nsa_model(self) -> nsa.NsaModel:
        return nsa.train(self.vectors, self.cfg, self.max_dim, self.cfg.train_steps)

    @cached_property
    def kmeans_models(self) -> DataFrame:
        rows = self.features(self.cfg.kmeans_shape)
        return materialise(kmeans.train(rows, self.cfg, self.cfg.train_steps), "kmeans-models")

    @cached_property
    def models(self) -> Models:
        return Models(
            gated=self.gated,
            selected=self.selected,
            nsa=self.nsa_model if self.cfg.use_nsa else None,
            kmeans=self.kmeans_models if self.cfg.use_kmeans else None,
        )


    @property
    def scored_metrics(self) -> Models:
        """Selection without any trained model."""
        return Models(self.gated, self.selected, None, None)

    @property
    def models_without_nsa(self) -> Models:
        return Models(self.gated, self.selected, None, self.kmeans_models)


def train(points: DataFrame, now: int, cfg: DetectorConfig) -> Models:
    """Model tables of every instance with usable data."""
    return TrainingRun(points, now, cfg).models


def scoring_means(points: DataFrame, models: Models, now: int, cfg: DetectorConfig) -> DataFrame:
    """Grid means of the scoring window, of metrics that passed the gate at training. Raw points
    are averaged first and only the means meet the model tables."""
    window = source.series_points(source.scoring_range(points, now, cfg), cfg.metric_prefix)
    means = grid_means(window, cfg.freq)
    kept = means.join(models.gated.select(*SERIES), [*SERIES], "left_semi")
    if cfg.strict_instances:
        whole = gates.complete_instances(models.selected, kept)
        kept = kept.join(whole.select(*INSTANCE), [*INSTANCE], "left_semi")
    return kept


def scoring_frame(points: DataFrame, models: Models, now: int, cfg: DetectorConfig) -> DataFrame:
    return align_means(scoring_means(points, models, now, cfg), cfg, steps=cfg.score_steps)


def scoring_features(
    aligned: DataFrame,
    models: Models,
    shape: FeatureShape,
    cfg: DetectorConfig,
    keys: tuple[str, ...] = INSTANCE,
) -> DataFrame:
    scaled = features.minmax_transform(aligned, models.selected)
    return features.featurise(scaled, shape, cfg, keys, steps=cfg.score_steps, scoring=True)


def nsa_scores(
    aligned: DataFrame, models: Models, cfg: DetectorConfig, keys: tuple[str, ...] = INSTANCE
) -> DataFrame:
    rows = scoring_features(aligned, models, cfg.nsa_shape, cfg, keys)
    return _nsa_scores(rows, models, cfg, keys)


def _nsa_scores(
    rows: DataFrame, models: Models, cfg: DetectorConfig, keys: tuple[str, ...]
) -> DataFrame:
    vectors = features.vectors(rows, cfg.nsa_shape, keys)
    queries = cfg.score_steps if keys == INSTANCE else None
    refs = cfg.train_steps + cfg.max_detectors
    return nsa.score(vectors, models.nsa, cfg, keys, max_queries=queries, max_points=refs)


def kmeans_scores(
    aligned: DataFrame, models: Models, cfg: DetectorConfig, keys: tuple[str, ...] = INSTANCE
) -> DataFrame:
    rows = scoring_features(aligned, models, cfg.kmeans_shape, cfg, keys)
    return kmeans.score(rows, models.kmeans, cfg, keys)


def scores(
    aligned: DataFrame, models: Models, cfg: DetectorConfig, keys: tuple[str, ...] = INSTANCE
) -> tuple[DataFrame | None, DataFrame | None]:
    """Scores of the methods that have a model. Both read the features from one written table."""
    if models.nsa is None and models.kmeans is None:
        raise ValueError("both methods are switched off")
    if models.kmeans is None:
        return nsa_scores(aligned, models, cfg, keys), None
    if models.nsa is None:
        return None, kmeans_scores(aligned, models, cfg, keys)
    if cfg.nsa_shape != cfg.kmeans_shape:
        once = materialise(aligned, "scoring")
        return nsa_scores(once, models, cfg, keys), kmeans_scores(once, models, cfg, keys)
    rows = scoring_features(aligned, models, cfg.nsa_shape, cfg, keys)
    rows = materialise(rows, "scoring-features")
    return _nsa_scores(rows, models, cfg, keys), kmeans.score(rows, models.kmeans, cfg, keys)


def detections(
    points: DataFrame, models: Models, now: int, cfg: DetectorConfig, margin: int | None = None
) -> DataFrame:
    """Detection rows of the scoring window before ``now``, all methods."""
    whole, single = scores(scoring_frame(points, models, now, cfg), models, cfg)
    found = []
    if whole is not None:
        rates = detect.nsa_window_rate(whole, cfg)
        found.append(detect.nsa_detections(rates, models.selected, now, cfg, margin))
    if single is not None:
        rates = detect.kmeans_window_rate(single, cfg)
        found.append(detect.kmeans_detections(rates, now, cfg, margin))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
