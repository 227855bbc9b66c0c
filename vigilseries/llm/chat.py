"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets the dialogue once from their own seat: their turns are those
of the assistant, everybody else is a named user, and the mask marks what the assistant says. Turns
are rendered in blocks of consecutive turn numbers, so a conversation of any length is many rows; the
blocks of a perspective in order are the whole dialogue. A block with very many rows (turns without
number or conversation, repeated numbers) is several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseries.functions.columns import SALTS, every_salt
from vigilseries.functions.storage import materialise
from vigilseries.llm.text import column

BLOCK_TURNS = 256
PART_ROWS = 1_024  # rows of a part of a block
PART = 2**44  # later parts of a block have multiples of this added to its number
CHUNK_ROWS = 20_000  # rows that are numbered in one task
PREFIX = 1_000  # characters by which the texts of a block in parts are ordered
CONTEXT = ("system",)  # speakers who are never a participant
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(speaker: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    named = F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n"))
    return (
        F.when(speaker == perspective, F.lit(f"{OPEN}assistant\n"))
        .when(speaker.isin(*context), F.concat(F.lit(OPEN), speaker, F.lit("\n")))
        .otherwise(named)
    )


def in_order(block: Column) -> tuple[Column, Column]:
    """Sort by these to have the blocks of a perspective, and their parts, in order."""
    return F.pmod(block + PART // 2, F.lit(PART)), block


def _parted(plain: DataFrame, rows: int) -> DataFrame:
    """``plain`` with ``part``: rows of a block by their order, at most ``rows`` in each. Only blocks
    of more rows are ordered, by range, so that one block is many tasks; equal rows spread."""
    key = ["conv_id", "block"]
    counts = plain.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows)
    large = materialise(counts, "chat-large-blocks")
    total = large.agg(F.sum("n")).first()[0]
    if total is None:
        return plain.withColumn("part", F.lit(0).cast("long"))
    marks = large.select(F.col("conv_id").alias("l_conv"), F.col("block").alias("l_block"), every_salt().alias("l_salt"))
    marked = plain.withColumn("row", F.monotonically_increasing_id()).join(
        marks,
        F.col("conv_id").eqNullSafe(F.col("l_conv"))
        & (F.col("block") == F.col("l_block"))
        & (F.pmod("row", F.lit(SALTS)).cast("int") == F.col("l_salt")),
        "left",
    )
    marked = materialise(marked.drop("l_conv", "l_salt"), "chat-turns")
    order = ["turn", "who", F.left("text", F.lit(PREFIX)), F.xxhash64("text"), "row"]
    ranged = (
        marked.where("l_block is not null")
        .repartitionByRange(-(-total // CHUNK_ROWS), *key, *order)
        .withColumn("chunk", F.spark_partition_id())
    )
    ranged = materialise(ranged, "chat-ranges")  # a chunk stays what it is
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*key, "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.col("chunk").alias("b_chunk"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    within = Window.partitionBy(*key, "chunk").orderBy(*order)
    numbered = ranged.withColumn("nth", F.row_number().over(within)).join(
        bases,
        F.col("conv_id").eqNullSafe(F.col("b_conv"))
        & (F.col("block") == F.col("b_block"))
        & (F.col("chunk") == F.col("b_chunk")),
    )
    part = F.floor((F.col("base") + F.col("nth") - 1) / rows).cast("long")
    few = marked.where("l_block is null").select(*plain.columns, F.lit(0).cast("long").alias("part"))
    return few.unionByName(numbered.select(*plain.columns, part.alias("part")))


def _number(block: Column, part: Column) -> Column:
    fits = (F.abs(block) < PART // 2) & (part < 2**63 // PART - 1)
    wrong = F.raise_error(F.lit("a block of this turn number has more parts than block numbers can tell"))
    return F.when(part == 0, block).when(fits, block + part * PART).otherwise(wrong.cast("long"))


def rotated(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context: tuple[str, ...] = CONTEXT,
    block_turns: int = BLOCK_TURNS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``conv_id, perspective, block, text, masks, n_turns, n_masked`` per participant and block.

    ``masks`` lists the spans of the assistant's words as ``start:end`` in code points of the block,
    end exclusive. Turns are ordered by number, then speaker and text; repeated rows are repeated
    turns. A null text is empty, a null speaker is called ``unknown``, turns without a number come
    first in a block of their own (-1), turns without a conversation form one. A conversation with
    nobody but context speakers has no perspective. An empty table gives an empty result.

    A block of more than ``part_rows`` rows is parts of so many; the first has the number of the
    block, later ones have multiples of ``PART`` added (see :func:`in_order`). Texts of one turn
    number and speaker are then ordered by their first characters and a hash.
    """
    who = F.coalesce(column(speaker), F.lit("unknown"))
    block = F.coalesce(F.floor(column(turn) / block_turns), F.lit(-1)).cast("long")
    plain = turns.select(
        column(conversation).alias("conv_id"), column(turn).cast("long").alias("turn"),
        who.alias("who"), F.coalesce(column(text), F.lit("")).alias("text"), block.alias("block"),
    )
    plain = _parted(plain, part_rows)
    seats = plain.select("conv_id", "who").where(~F.col("who").isin(*context)).distinct()
    spots = plain.select("conv_id", "block", "part").distinct()
    # Small rows meet on the conversation; the texts move once, to their block.
    views = spots.join(
        seats.select(F.col("conv_id").alias("of"), F.col("who").alias("perspective")),
        F.col("conv_id").eqNullSafe(F.col("of")),
    ).select(F.col("conv_id").alias("v_conv"), F.col("block").alias("v_block"), F.col("part").alias("v_part"), "perspective")
    grouped = plain.groupBy("conv_id", "block", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "who", "text"))).alias("turns")
    )
    joined = grouped.join(
        views,
        F.col("conv_id").eqNullSafe(F.col("v_conv"))
        & (F.col("block") == F.col("v_block"))
        & (F.col("part") == F.col("v_part")),
    )
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            _head(t["who"], F.col("perspective"), context).alias("head"),
            t["text"].alias("text"),
            (t["who"] == F.col("perspective")).alias("own"),
        ),
    )
    rendered = joined.select(
        "conv_id", "perspective", _number(F.col("block"), F.col("part")).alias("block"), parts.alias("parts")
    )

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(
            (end + len(CLOSE)).alias("at"),
            F.when(p["own"], F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
            (state["masked"] + F.when(p["own"], F.length(p["text"])).otherwise(0)).alias("masked"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<string>").alias("spans"),
        F.lit(0).alias("masked"),
    )
    return rendered.select(
        "conv_id", "perspective", "block",
        F.array_join(
            F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), ""
        ).alias("text"),
        F.aggregate("parts", start, step).alias("m"),
        F.size("parts").cast("long").alias("n_turns"),
    ).select(
        "conv_id", "perspective", "block", "text",
        F.array_join("m.spans", ",").alias("masks"),
        "n_turns", F.col("m.masked").cast("long").alias("n_masked"),
    )
