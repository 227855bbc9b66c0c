"""Parameters of the detector. Defaults are the production values; tests change ``freq``."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400
MINUTE = 60


@dataclass(frozen=True)
class FeatureShape:
    """How a value series becomes a feature vector."""

    lags: int = 3
    diffs: int = 1
    smooth: int = 3

    @property
    def width(self) -> int:
        return self.lags + 1 if self.lags >= 1 else 1

    @property
    def lost_rows(self) -> int:
        """Leading rows without a complete vector."""
        return max(self.diffs, 0) + max(self.smooth - 1, 0) + max(self.lags, 0)

    @property
    def warmup_rows(self) -> int:
        """Leading rows of a scoring window that are never scored."""
        return 2 * self.lags + self.diffs + self.smooth + 1


@dataclass(frozen=True)
class DetectorConfig:
    # time grid, in seconds
    freq: int = MINUTE
    train_seconds: int = DAY
    score_seconds: int = 120 * MINUTE
    discovery_days: int = 1
    max_instances: int | None = None

    # gates
    metric_prefix: str = "adt_"
    min_records: int = 50

    # metric selection
    variance_floor: float = 0.001
    correlation_limit: float = 0.9
    importance_bins: int = 16
    importance: str = "bins"  # bins | forest
    forest_trees: int = 50
    forest_depth: int = 8
    top_n: int = 10
    iqr_filter: bool = False
    lower_quantile: float = 0.10
    upper_quantile: float = 0.90

    # features
    nsa_shape: FeatureShape = FeatureShape()
    kmeans_shape: FeatureShape = FeatureShape()

    # negative selection
    use_nsa: bool = True
    max_detectors: int = 500
    max_attempts: int = 10
    self_percentage: float = 0.05
    seed_mode: str = "corners"  # none | corners | centroids
    neighbours: int = 5
    nsa_percentile: float = 95.0
    seed: int = 42

    # two clusters per metric
    use_kmeans: bool = True
    kmeans_iterations: int = 100
    kmeans_percentile: float = 95.0
    kmeans_fixed_threshold: float = 0.20

    # detections
    anomaly_bit_max: int = 1
    strict_instances: bool = False  # True: no result at all where a selected metric has no data
    nsa_rate_limit: float = 20.0
    kmeans_rate_limit: float = 20.0
    level: int = 3
    horizon: int = 300
    safety_margin: int = 100
    cycles_per_model: int = 12
    retention_seconds: int = 30 * DAY
    # Put in front of "nsa" / "kmeans" in the method tag, and of control / alert topics.
    method_prefix: str = ""
    topic_prefix: str = ""

    # time steps per window partition; longer series are split by time (see operators.chunks)
    chunk_steps: int = 10_000

    @property
    def train_steps(self) -> int:
        return -(-self.train_seconds // self.freq) + 1

    @property
    def score_steps(self) -> int:
        return -(-self.score_seconds // self.freq) + 1

    @property
    def nsa_method(self) -> str:
        return f"{self.method_prefix}nsa"

    @property
    def kmeans_method(self) -> str:
        return f"{self.method_prefix}kmeans"
