"""Exact duplicates by content sort.

Texts are range-partitioned at sampled splitters, sorted outside memory, and every row is compared
in full with its neighbour. The order is that of the first characters, a digest, the text and the
identifier; splitters hold no whole text, and since the identifier is part of them a large group of
copies spreads over many partitions. Runs that cross a border are linked by one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column, normalised, row_struct

LEAD = 32  # characters of a text in a splitter

EDGE = T.StructType(
    [
        T.StructField("first_text", T.StringType()),
        T.StructField("last_text", T.StringType()),
        T.StructField("runs", T.LongType()),
    ]
)


def _sorted(docs: DataFrame, id_column: str, text_column: str, carry: bool) -> DataFrame:
    text = column(text_column)
    columns = [column(id_column).alias("id"), F.sha2(normalised(text), 256).alias("sha")]
    columns += [F.substring(normalised(text), 1, LEAD).alias("lead")]
    if carry:
        columns += [text.alias("text"), row_struct(docs, (text_column,)).alias("row")]
    else:
        columns += [normalised(text).alias("norm")]
    keyed = docs.select(*columns).repartitionByRange("lead", "sha", F.asc_nulls_last("id"))
    if carry:
        keyed = keyed.withColumn("norm", normalised(F.col("text")))
    return keyed.sortWithinPartitions("lead", "sha", "norm", F.asc_nulls_last("id")).drop("lead")


def _runs(docs: DataFrame, id_column: str, text_column: str, carry: bool) -> DataFrame:
    """Sorted rows with partition, run and whether the row starts its run; with ``carry`` only
    those that do, with their other columns. One more row per partition holds its edge texts."""
    ordered = _sorted(docs, id_column, text_column, carry)
    kept = [T.StructField(f.name, f.dataType) for f in ordered.schema.fields if f.name != "norm"]
    schema = T.StructType(
        [
            *kept,
            T.StructField("part", T.IntegerType()),
            T.StructField("run", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("edge", EDGE),
        ]
    )
    names = [f.name for f in kept]
    edge_type = pa.struct(
        [("first_text", pa.string()), ("last_text", pa.string()), ("runs", pa.int64())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first_text = last_text = None
        run, types = -1, None
        for batch in batches:
            n = batch.num_rows
            types = {c: batch.schema.field(c).type for c in names}
            if n == 0:
                continue
            norm = batch.column("norm")
            same = np.zeros(n, bool)
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begin = norm[0].as_py()
            same[0] = last_text is not None and begin == last_text
            first_text = begin if first_text is None else first_text
            last_text = norm[n - 1].as_py()
            numbers = run + np.cumsum(~same)
            run = int(numbers[-1])
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.full(n, part, np.int32))]
                + [pa.array(numbers, pa.int64()), pa.array(~same), pa.nulls(n, edge_type)],
                [*names, "part", "run", "first", "edge"],
            )
            yield out.filter(pa.array(~same)) if carry else out
        if last_text is not None:
            edge = {"first_text": first_text, "last_text": last_text, "runs": run + 1}
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, types[c]) for c in names), pa.array([part], pa.int32())]
                + [pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([edge], edge_type)],
                [*names, "part", "run", "first", "edge"],
            )

    return ordered.mapInArrow(number, schema)


def _linked(table: DataFrame) -> DataFrame:
    """One row per partition: does its first run continue the one before?"""
    order = Window.orderBy("part")
    edges = table.where(F.col("edge").isNotNull()).select("part", "edge.*")
    joined = F.lag("last_text").over(order).eqNullSafe(F.col("first_text"))
    return edges.select("part", "runs", joined.alias("joined"))


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with the class of its normalised text: ``id, keep_id, group_size, kept, sha``.

    Texts are equal when identical after every run of white space became one blank; a null is an
    empty text, and empty texts are equal. The row with the smallest identifier stays, rows without
    one come last. Of repeated rows (same identifier and text) one is kept. Identifiers may repeat
    with different texts. An empty table gives an empty result; other columns are not looked at.
    """
    table = materialise(_runs(docs, id_column, text_column, False), "content-runs")
    rows = table.where(F.col("edge").isNull())
    local = materialise(
        rows.groupBy("part", "run").agg(
            F.count(F.lit(1)).alias("size"), F.min("id").alias("least")
        ),
        "content-run-sizes",
    )
    # A chain is a run that crosses partitions; at most two runs of each partition are in one.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.when(F.col("joined"), 0).otherwise(1) + F.when(F.col("runs") > 1, 1).otherwise(0)
    edges = _linked(table).withColumn("last_chain", F.sum(breaks).over(so_far))
    first_chain = F.col("last_chain") - F.when(F.col("runs") > 1, 1).otherwise(0)
    ends = edges.select(
        "part",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.lit(0).cast("long").alias("run"), first_chain.alias("chain")),
                    F.struct((F.col("runs") - 1).alias("run"), F.col("last_chain").alias("chain")),
                )
            )
        ).alias("end"),
    ).select("part", "end.run", "end.chain")
    chains = local.join(ends, ["part", "run"]).groupBy("chain").agg(
        F.sum("size").alias("all_size"),
        F.min("least").alias("all_least"),
        F.min(F.struct("part", "run")).alias("head"),
    )
    chained = ends.join(chains, "chain").select(
        "part",
        "run",
        "all_size",
        "all_least",
        (F.struct("part", "run") == F.col("head")).alias("is_head"),
    )
    chained = materialise(chained, "content-chains")
    runs = local.join(chained, ["part", "run"], "left").select(
        "part",
        "run",
        F.coalesce("all_size", "size").alias("group_size"),
        # the chain's least may be null where every identifier is
        F.when(F.col("is_head").isNull(), F.col("least")).otherwise(F.col("all_least")).alias("keep_id"),
        F.coalesce("is_head", F.lit(True)).alias("is_head"),
    )
    return rows.join(runs, ["part", "run"]).select(
        "id", "keep_id", "group_size", (F.col("first") & F.col("is_head")).alias("kept"), "sha"
    )


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows that stay, with all their columns; see :func:`classes` for which those are."""
    table = materialise(_runs(docs, id_column, text_column, True), "content-firsts")
    again = materialise(_linked(table).where("joined").select("part"), "content-continued")
    again = again.select("part", F.lit(0).cast("long").alias("run"))
    kept = table.where(F.col("edge").isNull()).join(again, ["part", "run"], "left_anti")
    return kept.select(
        *[
            (F.col("text") if c == text_column else F.col("row")[c]).alias(c)
            for c in docs.columns
        ]
    )
