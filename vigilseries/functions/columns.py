"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANCE = ("application", "instance")
SERIES = ("application", "instance", "metric")


def encode_destination(key: Column) -> Column:
    """``", "`` becomes ``---``; only without it, ``,`` becomes ``--``."""
    return (
        F.when(F.contains(key, F.lit(", ")), F.replace(key, F.lit(", "), F.lit("---")))
        .when(F.contains(key, F.lit(",")), F.replace(key, F.lit(","), F.lit("--")))
        .otherwise(key)
    )


def decode_destination(key: Column) -> Column:
    """Reverse of :func:`encode_destination`; a literal ``--`` comes back as ``,``."""
    spaced = F.replace(key, F.lit("---"), F.lit(", "))
    return F.replace(spaced, F.lit("--"), F.lit(","))


def metric_name(measurement: Column, destination: Column) -> Column:
    return F.concat_ws("_", measurement, encode_destination(destination))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def utc_day(seconds: Column) -> Column:
    """Calendar day in UTC, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor(seconds / 86_400).cast("int"))


def grid_floor(seconds: Column, freq: int) -> Column:
    """Start of the grid step that holds an epoch second."""
    return seconds - F.pmod(seconds, F.lit(freq).cast("long"))


def missing_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def euclidean(left: list[Column], right: list[Column]) -> Column:
    """Distance of two points given as columns, one generated sum of squares."""
    total = None
    for a, b in zip(left, right, strict=True):
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return F.sqrt(total)


def vector_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def vector_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5, the same in any engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


SALTS = 16  # parts of a key that may hold much of the data


def salt(*parts: Column) -> Column:
    """Which part of its key a row is in."""
    return F.pmod(F.xxhash64(*parts), F.lit(SALTS)).cast("int")


def every_salt() -> Column:
    """A row of the small side for each part of the key."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
