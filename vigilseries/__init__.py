"""Fleet-wide anomaly detection over monitoring metrics, written as Spark DataFrame jobs."""

from vigilseries.config import DetectorConfig, FeatureShape

__all__ = ["DetectorConfig", "FeatureShape"]
