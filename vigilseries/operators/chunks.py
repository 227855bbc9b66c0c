"""Windows over long series.

A gridded series has at most (range / step) rows. Where that bound is known and small, a window is
partitioned by the series. Where it is not, the series is cut in chunks of ``chunk_steps`` grid
steps, so that one very long series is spread over many tasks. Fixed-width windows need only the
last few rows before a chunk; these are copied into it (halo rows) and dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig

CHUNK = "_chunk"


def is_long(cfg: DetectorConfig, steps: int | None) -> bool:
    """True where the rows per series are unknown or exceed one chunk."""
    return steps is None or steps > cfg.chunk_steps


def chunk_of(t, cfg: DetectorConfig):
    return F.floor(t / F.lit(cfg.freq * cfg.chunk_steps)).cast("long")


def over_series(
    frame: DataFrame,
    keys: Sequence[str],
    cfg: DetectorConfig,
    steps: int | None,
    halo: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Apply ``compute(frame, window)``, whose window functions look back at most ``halo`` rows.

    ``compute`` must keep ``t`` and must not number rows (a chunk starts in the middle).
    """
    if not is_long(cfg, steps):
        return compute(frame, Window.partitionBy(*keys).orderBy("t"))
    if halo >= cfg.chunk_steps:
        raise ValueError("chunk_steps must exceed the rows a feature looks back")
    own = chunk_of(F.col("t"), cfg)
    near_end = F.pmod(F.floor(F.col("t") / cfg.freq), F.lit(cfg.chunk_steps)) >= (
        cfg.chunk_steps - halo
    )
    spread = F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    chunked = frame.withColumn(CHUNK, spread)
    result = compute(chunked, Window.partitionBy(*keys, CHUNK).orderBy("t"))
    return result.where(F.col(CHUNK) == chunk_of(F.col("t"), cfg)).drop(CHUNK)
