import math

import pytest
from pyspark.sql import functions as F

from vigilseries.functions import columns as c


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("key", "encoded", "decoded"),
    [
        ("a, b", "a---b", "a, b"),
        ("a,b", "a--b", "a,b"),
        ("a--b", "a--b", "a,b"),
        ("a, b,c", "a---b,c", "a, b,c"),
        ("plain", "plain", "plain"),
        ("", "", ""),
    ],
)
def test_destination_keys(spark, key, encoded, decoded):
    assert one(spark, c.encode_destination(F.lit(key))) == encoded
    assert one(spark, c.decode_destination(F.lit(encoded))) == decoded


def test_metric_name(spark):
    assert one(spark, c.metric_name(F.lit("adt_net"), F.lit("in, out"))) == "adt_net_in---out"


def test_grid_floor(spark):
    assert one(spark, c.grid_floor(F.lit(125).cast("long"), 60)) == 120
    assert one(spark, c.grid_floor(F.lit(120).cast("long"), 60)) == 120
    assert one(spark, c.grid_floor(F.lit(-1).cast("long"), 60)) == -60


def test_distances(spark):
    a = [F.lit(0.0), F.lit(3.0)]
    b = [F.lit(4.0), F.lit(0.0)]
    assert one(spark, c.euclidean(a, b)) == 5.0
    assert one(spark, c.vector_distance(F.array(*a), F.array(*b))) == 5.0
    assert one(spark, c.vector_norm(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(math.sqrt(2))


def test_hash_uniform_is_uniform_and_repeatable(spark):
    rows = spark.range(20000).select(c.hash_uniform(F.lit(7), F.col("id")).alias("u"))
    low, high, mean = rows.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01
    assert rows.exceptAll(rows).count() == 0


def test_nan_is_missing(spark):
    assert one(spark, c.missing_if_nan(F.lit(float("nan")))) is None
    assert one(spark, c.missing_if_nan(F.lit(1.5))) == 1.5
