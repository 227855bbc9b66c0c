"""The given star-schema tables read as monitoring data, for the registered queries.

``events`` are metric points of four instances in two applications, ``embeddings`` labelled
vectors, ``lineitem`` a daily series per flag and status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseries.config import DAY, DetectorConfig

HOUR = 3600
NOW = 1_706_659_200  # 2024-01-31T00:00:00Z, the end of the events table

# Hourly grid: 25 days of training, 5 days (120 steps) of scoring.
CONFIG = DetectorConfig(
    freq=HOUR,
    train_seconds=25 * DAY,
    score_seconds=5 * DAY,
    discovery_days=30,
    top_n=5,
    horizon=HOUR,
    safety_margin=100,
)

METRICS = [
    f"adt_{kind}_eth0{key}"
    for kind in ("click", "error", "purchase", "view")
    for key in ("--out", "---in")
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_points(events: DataFrame, groups: int = 2) -> DataFrame:
    """``groups`` applications with two instances each."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat(F.lit("shop_"), F.col("user_id") % groups).alias("application"),
        F.concat(F.lit("instance_"), F.floor(F.col("user_id") / groups) % 2).alias("instance"),
        F.when(F.col("event_type") == "signup", F.lit("sys_signup"))
        .otherwise(F.concat(F.lit("adt_"), F.col("event_type")))
        .alias("measurement"),
        F.when(k % 2 == 0, F.lit("eth0, in")).otherwise(F.lit("eth0,out")).alias("destination_key"),
        F.when(k % 5 == 0, F.lit("raw")).otherwise(F.lit("value")).alias("field"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def points(spark: SparkSession, sf_dir: str, groups: int = 2) -> DataFrame:
    return as_points(read(spark, sf_dir, "events"), groups)


def as_control(events: DataFrame) -> DataFrame:
    """One message per event: errors go to another topic, every seventh value of k has no name,
    every fifth no version."""
    k = F.get_json_object("props", "$.k").cast("long")
    name = F.when(k % 7 != 0, F.concat(F.lit("shop_"), F.col("user_id") % 3))
    bound = F.struct(
        F.concat(F.lit("adt_"), F.col("event_type")).alias("name"),
        F.lit("-Infinity").alias("lower_bound"),
        F.lit("Infinity").alias("upper_bound"),
    )
    body = F.to_json(
        F.struct(
            name.alias("name"),
            F.when(k % 5 != 0, k).alias("version"),
            F.array(bound).alias("metric_list"),
        )
    )
    return events.select(
        F.when(F.col("event_type") == "error", F.lit("topic://monitoring.realtime"))
        .otherwise(F.lit("topic://monitoring.metric_list"))
        .alias("topic"),
        F.concat(F.lit("shop_"), F.col("user_id") % 3).alias("subject"),
        body.alias("body"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("event_id").alias("offset"),
    )


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_control(read(spark, sf_dir, "events"))


def stored_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows a detection store could hold, some of them written again later."""
    events = read(spark, sf_dir, "events")
    nsa = F.col("event_type") == "error"
    node = F.concat(F.lit("instance_"), F.col("user_id") % 4)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    hour = seconds - seconds % HOUR
    metric = F.concat(F.lit("adt_"), F.col("event_type"))
    method = F.when(nsa, F.lit("nsa")).otherwise(F.lit("kmeans"))
    name = F.concat_ws("_", F.lit("_predicted"), method, node, F.when(~nsa, metric))
    return events.select(
        F.timestamp_seconds(hour).alias("time"),
        name.alias("measurement"),
        F.concat(F.lit("shop_"), F.col("user_id") % 2).alias("application_name"),
        node.alias("node"),
        method.alias("method"),
        F.when(nsa, F.lit("adt_click,adt_view")).otherwise(metric).alias("metrics"),
        F.lit("3").alias("level"),
        F.least("value", F.lit(100.0)).alias("metricValue"),
        (F.col("value") >= 20).alias("anomaly"),
        (hour + HOUR).alias("predictionTime"),
        (hour - 120 * HOUR).alias("window_start"),
        hour.alias("window_end"),
        F.col("event_id").alias("written"),
    )


def labelled_vectors(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Embeddings scaled to [0, 1] per dimension; class 0 is normal (label 0), the rest are not."""
    rows = read(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("application"),
        F.lit("all").alias("instance"),
        F.col("vec_id").alias("rid"),
        F.col("label").alias("kind"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("label"),
        F.col("embedding").cast("array<double>").alias("raw"),
    )
    at = lambda j: F.get("raw", F.lit(j))
    # The fitted scaler: two numbers per dimension.
    fitted = rows.agg(
        F.array(*[F.min(at(j)) for j in range(dim)]).alias("low"),
        F.array(*[F.max(at(j)) for j in range(dim)]).alias("high"),
    ).first()
    scaled = F.array(
        *[
            (at(j) - F.lit(low)) / (F.lit(high) - F.lit(low))
            for j, (low, high) in enumerate(zip(fitted["low"], fitted["high"], strict=True))
        ]
    )
    return rows.select("application", "instance", "rid", "kind", "label", scaled.alias("vec"))


def daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of four line item columns per flag and status: a wide frame."""
    items = read(spark, sf_dir, "lineitem")
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    return (
        items.select(
            F.lit("lineitem").alias("application"),
            F.concat("l_returnflag", "l_linestatus").alias("instance"),
            (seconds - seconds % DAY).alias("t"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        )
        .groupBy("application", "instance", "t")
        .agg(
            F.avg("l_quantity").alias("quantity"),
            F.avg("l_extendedprice").alias("price"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
        )
    )


DAILY = ["quantity", "price", "discount", "tax"]
