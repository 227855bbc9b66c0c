"""Scoring windows from carried state.

A sliding window aggregate keeps every grid mean once for each window that covers it (24 times for two
hours every five minutes). Here a series keeps the means of its last window once, as sorted arrays, and
wakes up at the next border; what leaves is the same as from ``streams.sliding_windows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilseries.config import DetectorConfig
from vigilseries.functions.columns import SERIES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOWS_AT_ONCE = 256  # windows of a series in one batch of rows, when a backlog is read
STATE = "done long, ends array<long>, means array<double>"
OUTPUT = "application string, instance string, metric string, window_end long, ends array<long>, means array<double>"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that carried windows need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Ring(StatefulProcessor):
    """The means of a series that a window still to come can cover."""

    def __init__(self, span: int, slide: int) -> None:
        self.span, self.slide, self.shift = span, slide, span % slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        yield from self.advance(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key: tuple, rows, watermark: int) -> Iterator[pd.DataFrame]:
        held = self.ring.get() if self.ring.exists() else None
        done, ends, values = held if held is not None else (None, [], [])
        ends, values = [np.array(ends, dtype=np.int64)], [np.array(values, dtype=np.float64)]
        for part in rows:
            ends.append(part["ends"].to_numpy(np.int64))
            values.append(part["value"].to_numpy(np.float64))
        ends, values = np.concatenate(ends), np.concatenate(values)
        order = np.argsort(ends, kind="stable")
        ends, values = ends[order], values[order]

        slide, shift = self.slide, self.shift
        last = (watermark // 1000 - shift) // slide * slide + shift  # the latest border passed
        if len(ends):
            first = -((shift - int(ends[0])) // slide) * slide + shift  # the first one that has a step
            if done is not None:
                first = max(first, done + slide)
            for begin in range(first, last + 1, slide * WINDOWS_AT_ONCE):
                stop = min(begin + slide * WINDOWS_AT_ONCE, last + 1)
                yield self.windows(key, ends, values, np.arange(begin, stop, slide))
        kept = ends > last + slide - self.span
        if kept.any():
            self.ring.update((last, ends[kept].tolist(), values[kept].tolist()))
            # A timer may be due only beyond its time, a window is when its end is reached. One left
            # from before finds the border done and sets this one again.
            self.handle.registerTimer(max((last + slide) * 1000 - 1, watermark + 1))
        elif held is not None:
            self.ring.clear()

    def windows(self, key: tuple, ends: np.ndarray, values: np.ndarray, borders: np.ndarray) -> pd.DataFrame:
        low = np.searchsorted(ends, borders - self.span, "right")
        high = np.searchsorted(ends, borders, "right")
        found = [(b, i, j) for b, i, j in zip(borders.tolist(), low, high, strict=True) if i < j]
        frame = {name: [part] * len(found) for name, part in zip(SERIES, key, strict=True)}
        frame["window_end"] = [b for b, _, _ in found]
        frame["ends"] = [ends[i:j].tolist() for _, i, j in found]
        frame["means"] = [[None if np.isnan(v) else v for v in values[i:j].tolist()] for _, i, j in found]
        return pd.DataFrame(frame)

    def close(self) -> None:
        pass


def carried_windows(means: DataFrame, cfg: DetectorConfig, slide_seconds: int) -> DataFrame:
    """Scoring windows of ``streams.grid_mean_stream``, with the schema of ``streams.sliding_windows``.

    A window ends at a multiple of the slide, counted like those of ``F.window``, and holds the steps
    that end after its start and not after its end; it leaves once the watermark has passed its end
    and is left out where no step falls into it. Steps come in order of time. A mean that is not a
    number counts as missing. State of a series: at most ``score_seconds / freq`` steps between
    batches, plus those the current batch adds; a series without steps in reach keeps none. Start the
    stream under :func:`state_store`.
    """
    span, freq = cfg.score_seconds, cfg.freq
    closed = F.window_time("step")
    steps = means.select(*SERIES, closed.alias("at"), F.unix_seconds("step.end").alias("ends"), "value")
    found = steps.groupBy(*SERIES).transformWithStateInPandas(
        Ring(span, slide_seconds), OUTPUT, "append", "eventTime"
    )
    point = F.transform(
        F.arrays_zip("ends", "means"),
        lambda p: F.struct((p["ends"] - freq).alias("t"), p["means"].alias("value")),
    )
    end = F.col("window_end")
    limits = F.struct(F.timestamp_seconds(end - span).alias("start"), F.timestamp_seconds(end).alias("end"))
    return found.select(limits.alias("span"), *SERIES, point.alias("points"))
