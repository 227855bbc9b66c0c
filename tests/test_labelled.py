"""Queries on the labelled vectors: what their model is trained with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_models import points, queries
from vigilseries.functions.columns import INSTANCE
from vigilseries.operators import neighbours, nsa
from vigilseries.plans import catalog


def test_labelled_model_starts_from_seeds(spark):
    v = np.random.default_rng(7).random((100, 64))
    rows = points(spark, v, labels=[0] * 90 + [1] * 10)
    balls = catalog.labelled_model(rows).detectors.orderBy("det_id").collect()
    assert len(balls) == catalog.C.max_detectors
    assert np.allclose(balls[0]["centre"], v[:90].min(axis=0))


def test_labelled_model_retries_rejected_candidates(spark):
    v = np.zeros((3, 64))
    v[1, 0], v[2, 1] = 1, 1
    rows = points(spark, v)
    first = catalog.labelled_model(rows).detectors.where("det_id = 0").collect()[0]
    # The lower corner is a normal point itself; it is moved until it fits.
    assert 0 < np.abs(first["centre"]).max() <= catalog.C.max_attempts * catalog.C.self_percentage


def test_whole_queries_have_sql():
    names = {"nsa_predict_whole", "nsa_tune_predict_whole", "nsa_tune_whole", "nsa_seeds_centroids"}
    assert names <= set(catalog.QUERIES) and names <= set(catalog.ORACLES)


@pytest.fixture
def met(monkeypatch):
    """What every search found, before it is put together: a row per query and group of rows that it met."""
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    found, meet = [], neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda *args: found.append(meet(*args)) or found[-1])
    return found


def most_rows(met):
    most = [rows.groupBy(*INSTANCE, "qid").count().agg(F.max("count")).first()[0] for rows in met]
    return max(n or 0 for n in most)


def uniform_model(spark, balls):
    """Vectors whose distances tell nothing apart, and a model of those with label 0."""
    rng = np.random.default_rng(6)
    rows = points(spark, rng.random((300, 16)), labels=[int(i % 4 > 0) for i in range(300)])
    known = spark.createDataFrame([("a", "i", 16, 0.2, 1.0)], "application string, instance string, dim int, self_radius double, threshold double")
    found = [("a", "i", n, c.tolist(), 0.7) for n, c in enumerate(rng.random((balls, 16)))]
    found = spark.createDataFrame(found, "application string, instance string, det_id int, centre array<double>, radius double")
    return rows, nsa.NsaModel(known, neighbours.distinct_points(nsa.self_points(rows)), found)


def test_tuning_holds_every_query_once(spark, met):
    """A missed anomaly is searched among all known points, but as one row, whatever cells it needs."""
    rows, model = uniform_model(spark, 3)
    tuned = nsa.tune(model, rows, rows)
    assert tuned.where("det_id is null").count() == 0  # every missed one is a known point itself
    assert met[-1].count() > 100 and most_rows(met[-1:]) == 1


@pytest.mark.parametrize("balls", [3, 100])
def test_tuning_prediction_holds_every_query_once(spark, met, balls):
    rows, model = uniform_model(spark, balls)
    assert nsa.tuning_prediction(queries(rows), model).count() == 300
    assert most_rows(met) == 1
