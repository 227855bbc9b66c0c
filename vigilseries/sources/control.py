"""Control messages: which applications are to be monitored.

Message frame: ``topic, subject, body (JSON text), received_at, offset``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField(
            "metric_list",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("lower_bound", T.StringType()),
                        T.StructField("upper_bound", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def control_messages(messages: DataFrame, topic_prefix: str = "") -> DataFrame:
    """Messages on ``monitoring.metric_list`` with their parsed body."""
    address = F.replace(F.col("topic"), F.lit("topic://" + topic_prefix), F.lit(""))
    body = F.from_json("body", CONTROL_SCHEMA)
    return messages.where(address == "monitoring.metric_list").select(
        "subject",
        body["name"].alias("application"),
        body["version"].alias("version"),
        body["metric_list"].alias("metric_list"),
        "received_at",
        "offset",
    )


def for_subject(messages: DataFrame, application: str) -> DataFrame:
    """Only messages whose subject is the application."""
    return messages.where(F.col("subject") == application)


def registry(control: DataFrame) -> DataFrame:
    """The last message of every named application wins; a missing version counts as 0."""
    latest = F.max_by("version", F.struct("received_at", "offset"))
    return (
        control.where(F.col("application").isNotNull() & (F.col("application") != ""))
        .select(
            "application",
            F.coalesce("version", F.lit(0)).alias("version"),
            "received_at",
            "offset",
        )
        .groupBy("application")
        .agg(latest.alias("version"))
    )
