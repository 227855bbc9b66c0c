"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source shall be copied ``target / source_size`` times on average. The whole part
is certain; of the fractional parts, pairs of documents fight: words move from one to the other, in a
random direction with fair odds, until one of them has a whole number of copies. Words are conserved,
so at the end one document per source is left with a fraction. Pairs meet in bounded groups first and
the one undecided document of each group moves up a reduction tree, level by level.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column, row_struct, word_count

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
LIMIT = 3  # a target is at most so many times its source
GROUP_ROWS = 20_000  # documents that fight in one task
FAN_IN = 256  # groups that meet in a node of the tree
SEED = 17


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from the words of every source.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share all words; a target
    stops at ``LIMIT`` times its source and the excess is shared again by weight until none is
    above. That end is one water level: capped sources are those with the smallest size per weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = per_source.withColumn("weight", weight).withColumn(
        "cap", F.col("source_size") * LIMIT
    )
    fullness = (F.col("cap") / F.col("weight")).asc()
    whole = Window.partitionBy()
    in_order = Window.orderBy(fullness, F.asc_nulls_last("source"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        F.sum("source_size").over(whole).alias("all_size"),
        F.sum("weight").over(whole).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
        F.row_number().over(in_order).alias("position"),
    )
    # The level if exactly the sources before this one are capped; the first source that it does
    # not cap sets it.
    rest = (F.col("all_size") - F.col("caps_before")).cast("double")
    level = level.withColumn("level", rest / (F.col("all_weight") - F.col("weights_before")))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.withColumn("water", F.min(F.when(free, F.struct("position", "level"))).over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("water.level") * F.col("weight"))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def pivotal(size: np.ndarray, share: np.ndarray, rank: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round shares in [0, 1) of documents in the given order; returns the shares, all 0 or 1 but
    for one, and the place of that one (-1 if none is left). Sizes are positive. The random number
    of a fight is a hash of the two documents' ranks."""
    share = share.copy()
    open_at = -1
    for i in range(len(size)):
        if share[i] <= 0.0 or share[i] >= 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        up = min((1 - share[a]) * size[a], share[b] * size[b])  # words from b to a
        down = min(share[a] * size[a], (1 - share[b]) * size[b])  # words from a to b
        mixed = (int(rank[a]) * 0x9E3779B97F4A7C15 + int(rank[b]) + seed) & 0xFFFFFFFFFFFFFFFF
        mixed = ((mixed ^ (mixed >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        mixed = ((mixed ^ (mixed >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        moved = up if (mixed >> 11) / (1 << 53) < down / (up + down) else -down
        share[a] += moved / size[a]
        share[b] -= moved / size[b]
        for k in (a, b):
            if share[k] < 1e-9:
                share[k] = 0.0
            elif share[k] > 1 - 1e-9:
                share[k] = 1.0
        left = [k for k in (a, b) if 0.0 < share[k] < 1.0]
        open_at = left[0] if left else -1
    return share, open_at


_FIGHT = "source string, node long, place long, rank long, size long, whole long, share double, open boolean"


def _fights(last: bool):
    def fight(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(
            table, [("rank", "ascending"), ("size", "ascending"), ("place", "ascending")]
        )
        table = table.take(order)
        rank = table["rank"].to_numpy()
        size = table["size"].to_numpy().astype(float)
        share, left = pivotal(size, table["share"].to_numpy(), rank, SEED)
        is_open = np.zeros(len(share), bool)
        if left >= 0:
            if last:  # the one fraction of a source is decided with its own probability
                mixed = (int(rank[left]) * 0xD6E8FEB86659FD93 + SEED) & 0xFFFFFFFFFFFFFFFF
                share[left] = float((mixed >> 11) / (1 << 53) < share[left])
            else:
                is_open[left] = True
        for name, values in (("share", share), ("open", is_open)):
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array(values))
        return table

    return fight


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    carry: bool = False,
) -> DataFrame:
    """Every document with ``size, source, source_size, target, copies, taken``, and with ``carry``
    its columns as ``row``.

    A null text has no words; a document without words is taken as often as the whole part of its
    source's ratio. A null source is a source of its own. Repeated rows fight like any others, and
    which of two equal ones wins does not matter; a null identifier takes part with its text's
    digest. The result is a function of the rows alone, in whatever order they come. An empty table
    gives an empty result.
    """
    text = column(text_column)
    who = F.coalesce(column(id_column).cast("string"), F.md5(text), F.lit(""))
    measured = docs.select(
        column(id_column).alias("id"),
        column(source_column).alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(who, F.lit(SEED)).alias("rank"),
        *([row_struct(docs).alias("row")] if carry else []),
    )
    light = materialise(measured.select("id", "source", "size", "rank"), "mixing-sizes")
    aims = materialise(targets(light), "mixing-targets")
    total = light.count()
    groups = max(1, -(-total // GROUP_ROWS))

    # Copies depend on (source, rank, size) and, for repeats, on their number.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    counted = light.groupBy("source", "rank", "size").agg(F.count(F.lit(1)).alias("times"))
    aimed = aims.withColumn("ratio", ratio).withColumnRenamed("source", "of")
    sized = counted.join(aimed, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Repeats of one key have equal shares; they are spelled out so that each is decided by itself.
    numbered = sized.select(
        "source",
        "rank",
        "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("place"),
        F.floor("ratio").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("share"),
    ).select(
        "source",
        F.pmod(F.xxhash64("rank", "size", "place"), F.lit(groups)).alias("node"),
        "place",
        "rank",
        "size",
        "whole",
        F.when(F.col("size") > 0, F.col("share")).otherwise(0.0).alias("share"),
        F.lit(True).alias("open"),
    )
    decided = []
    while True:
        last = groups == 1
        done = numbered.groupBy("source", "node").applyInArrow(_fights(last), _FIGHT)
        done = materialise(done, "mixing-level")
        decided.append(done.where(~F.col("open")))
        if last:
            break
        groups = -(-groups // FAN_IN)
        numbered = done.where("open").withColumn("node", F.pmod("node", F.lit(groups)))
    every = decided[0]
    for more in decided[1:]:
        every = every.unionByName(more)
    copies = every.select(
        "source", "rank", "size", "place", (F.col("whole") + F.round("share")).cast("long").alias("copies")
    )
    same = ["source", "rank", "size"]
    ordered = Window.partitionBy(*same).orderBy("id")
    left = measured.withColumn("place", (F.row_number().over(ordered) - 1).cast("long"))
    right = copies.select(*[F.col(c).alias(f"c_{c}") for c in (*same, "place", "copies")])
    meets = F.lit(True)
    for c in (*same, "place"):
        meets = meets & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    found = left.join(right, meets).join(
        aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    )
    return found.select(
        "id", "source", "size", "source_size", "target",
        F.col("c_copies").alias("copies"),
        (F.col("c_copies") * F.col("size")).alias("taken"),
        *(["row"] if carry else []),
    )


def resampled(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: every document as often as it is copied, with its columns."""
    found = mixed(docs, carry=True, **columns).where("copies > 0")
    every = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return every.select(*[F.col("row")[c].alias(c) for c in docs.columns])


