"""URL filters as a sort-merge range join of addresses with rules.

The key of an address is its host with the labels reversed, each followed by a dot, so a rule's host
is a prefix of the keys of all its subdomains: an interval of the sorted keys. Sampled splitters cut
the key space (together with a hash, so that one host can spread over many partitions); addresses go
to one partition, rules to every partition that their interval meets. Each sorted partition is swept
once with a stack of the rules whose interval is open, which nest like the domains do.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.llm.text import ascii_lower, column, row_struct

SAMPLED_PER_PARTITION = 20  # keys in the sample for each partition that is cut
ROWS_PER_PARTITION = 100_000

_RULE = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    reversed_labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(reversed_labels, "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, _RULE)


def _splitters(keyed: DataFrame) -> list[tuple[str, int]]:
    """At most one border per ``ROWS_PER_PARTITION`` addresses or task of the session."""
    spark = keyed.sparkSession
    total = keyed.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_PARTITION))
    step = max(1, total // (parts * SAMPLED_PER_PARTITION))
    sample = sorted(
        (r["key"], r["spread"])
        for r in keyed.where(F.pmod("spread", F.lit(step)) == 0).select("key", "spread").collect()
    )
    every = max(1, -(-len(sample) // parts))
    return sample[every::every]


class _Stack:
    """Rules whose interval holds the current key, outermost first."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.frames and not key.startswith(self.frames[-1][0]):
            self.frames.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, {}, []))
        _, rules, lengths = self.frames[-1]
        known = rules.get(path)
        if known is None and len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)
        if known is None or verdict == "block":
            rules[path] = (rule, verdict)

    def best(self, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule; of equally long ones that of the deeper host."""
        rule: tuple[str | None, str | None] = (None, None)
        longest = -1
        for _, rules, lengths in self.frames:
            for n in lengths:
                if n <= len(path) and path[:n] in rules:
                    found = rules[path[:n]]
                    if len(found[0]) >= longest:
                        rule, longest = found, len(found[0])
                    break
        return rule


def _sweep(default: str, row_type: pa.DataType | None = None):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = _Stack(), None
        for batch in batches:
            names = batch.schema.names
            cut, key, path, rule, verdict = (
                batch.column(names.index(c)).to_pylist()
                for c in ("part", "key", "path", "rule", "verdict")
            )
            rules: list[str | None] = []
            verdicts: list[str] = []
            asked: list[int] = []
            for i, k in enumerate(key):
                if cut[i] != part:
                    stack, part = _Stack(), cut[i]
                stack.close(k)
                if rule[i] is not None:
                    stack.open(k, path[i], rule[i], verdict[i])
                    continue
                found = stack.best(path[i])
                asked.append(i)
                rules.append(found[0])
                verdicts.append(found[1] or default)
            if asked:
                at = pa.array(asked)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(c)).take(at) for c in ("row", "host", "path")]
                    + [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                    ["row", "host", "path", "rule", "verdict"],
                )

    return sweep


def judged(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """``row`` (all columns of ``pages``), ``host, path, rule, verdict`` for every row.

    A rule ``host, path, verdict`` fits its host and all subdomains if the address's path starts
    with the rule's; the longest host and path together win, then the deeper host, then a block.
    Where none fits, ``rule`` is null and the verdict is ``default``. A null address, or one without
    ``://``, has an empty host and path. Rules with a null are left out; repeated rules and pages
    are judged alike; without rules or pages nothing breaks. Select the columns to carry first.
    """
    url = column(url_column)
    # The hash spreads one host, and one address, over partitions; the sample is drawn by it, too, so
    # that it grows with the partitions only and a frequent address has borders of its own.
    keyed = pages.select(
        row_struct(pages).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"),
        F.xxhash64(F.coalesce(url, F.lit("")), F.monotonically_increasing_id()).alias("spread"),
    ).withColumn("key", key_of(F.col("host")))
    borders = _splitters(keyed.select("key", "spread"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            pairs = zip(
                batch.column(names.index("key")).to_pylist(),
                batch.column(names.index("spread")).to_pylist(),
                strict=True,
            )
            part = pa.array([bisect_right(borders, pair) for pair in pairs], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], [*names, "part"])

    placed = keyed.mapInArrow(places, T.StructType([*keyed.schema.fields, T.StructField("part", T.IntegerType())]))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.names.index("key")).to_pylist()
            parts = [
                list(range(bisect_left(borders, (k, -(1 << 63))), _end(borders, k) + 1)) for k in keys
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "parts"]
            )

    known = rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict"
    ).withColumn("key", key_of(F.col("host")))
    spread_rules = known.mapInArrow(
        reach, "host string, path string, verdict string, key string, parts array<int>"
    ).select(
        F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), "host", "path", "key",
        F.explode("parts").alias("part"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    asked = placed.select(
        "row", "host", "path", "key", "part",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    merged = (
        asked.unionByName(spread_rules)
        .repartition(len(borders) + 1, "part")
        .sortWithinPartitions("part", "key", F.asc(F.col("rule").isNull()), "rule", "path")
    )
    schema = T.StructType(
        [
            T.StructField("row", keyed.schema["row"].dataType),
            *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")],
        ]
    )
    return merged.mapInArrow(_sweep(default), schema)


def _end(borders: list[tuple[str, int]], key: str) -> int:
    """The last partition that can hold a key that starts with ``key``."""
    low, high = 0, len(borders)
    while low < high:
        middle = (low + high) // 2
        border = borders[middle][0]
        if border.startswith(key) or border < key:
            low = middle + 1
        else:
            high = middle
    return low
