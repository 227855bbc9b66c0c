"""Model tables on shared storage, so that one training serves many scoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilseries.operators.nsa import NsaModel
from vigilseries.plans.pipeline import Models

NSA_PARAMS = (
    "application string, instance string, dim int, self_radius double, threshold double"
)
SCHEMAS = {
    "gated": "application string, instance string, metric string, ord int",
    "selected": "application string, instance string, metric string, ord int, vmin double, "
    "vmax double, importance double",
    "nsa_params": NSA_PARAMS,
    "nsa_self": "application string, instance string, vec array<double>, rid long, n long",
    "nsa_detectors": "application string, instance string, det_id int, centre array<double>, "
    "radius double",
    "kmeans": "application string, instance string, metric string, c0 array<double>, "
    "c1 array<double>, raw_min double, raw_max double, threshold double",
}


def _tables(models: Models) -> dict[str, DataFrame]:
    found = {"gated": models.gated, "selected": models.selected}
    if models.nsa is not None:
        found |= {
            "nsa_params": models.nsa.params,
            "nsa_self": models.nsa.self_points,
            "nsa_detectors": models.nsa.detectors,
        }
    if models.kmeans is not None:
        found["kmeans"] = models.kmeans
    return found


def save_models(models: Models, folder: str) -> Models:
    """Write the tables of a training below ``folder`` (one folder per training) and read them
    back from there."""
    for name, table in _tables(models).items():
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        table.select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}")
    return load_models(
        models.gated.sparkSession, folder, models.nsa is not None, models.kmeans is not None
    )


def load_models(
    spark: SparkSession, folder: str, use_nsa: bool = True, use_kmeans: bool = True
) -> Models:
    """Tables of a training written by :func:`save_models`."""

    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

    return Models(
        gated=table("gated"),
        selected=table("selected"),
        nsa=NsaModel(table("nsa_params"), table("nsa_self"), table("nsa_detectors"))
        if use_nsa
        else None,
        kmeans=table("kmeans") if use_kmeans else None,
    )
