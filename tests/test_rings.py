"""Windows from carried state against the sliding aggregate, over several batches and restarts."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vigilseries.config import DetectorConfig
from vigilseries.streaming import rings, streams

CFG = replace(DetectorConfig(), score_seconds=7200)
RAW = "application string, instance string, metric string, s long, value double"
START = 1_700_000_000


def rows_of(frame):
    return sorted(
        (
            (str(r.application), r.instance, r.metric, r["end"], sorted((p.t, p.value) for p in r.points))
            for r in frame.select("application", "instance", "metric", F.unix_seconds("span.end").alias("end"), "points").collect()
        ),
        key=str,
    )


def land(spark, path, rows, mode="append"):
    frame = spark.createDataFrame(rows, RAW)
    frame.select("application", "instance", "metric", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode(
        mode
    ).parquet(path)


def run(spark, path, out, make, files=1000):
    stream = (
        spark.readStream.schema("application string, instance string, metric string, ts timestamp, value double")
        .option("maxFilesPerTrigger", files)
        .parquet(path)
    )
    windows = make(streams.grid_mean_stream(stream, CFG, "60 seconds"))
    with rings.state_store(spark):
        streams.run_available(streams.table_sink(windows, out, f"{out}-mark"))
    return spark.read.schema(windows.schema).parquet(out)


def series(lo, hi, skip=()):
    rows = []
    for i in range(lo, hi):
        s = START + i * 45
        rows.append(("app", "a", "steady", s, float(i % 17)))
        if i % 3 and i not in skip:
            rows.append((None, "a", "gaps", s, float(i % 5)))
        if i < 40 or i > 420:
            rows.append(("app", "b", "silent for hours", s, None if i % 7 == 0 else i / 8))
    return rows


@pytest.mark.parametrize("slide", [300, 420])
def test_same_windows_as_the_aggregate(spark, tmp_path, slide):
    """420 divides neither the window nor, with a step of 60, every border of a window in time."""
    source = str(tmp_path / "in")
    for lo in range(0, 600, 150):  # four files, each a batch and most of them later than a border
        land(spark, source, series(lo, lo + 150))
    carried = run(spark, source, str(tmp_path / "c"), lambda m: rings.carried_windows(m, CFG, slide), 1)
    want = run(spark, source, str(tmp_path / "s"), lambda m: streams.sliding_windows(m, CFG, slide), 1)
    assert carried.schema.simpleString() == want.schema.simpleString()
    got = rows_of(carried)
    assert got == rows_of(want)
    assert {r[2] for r in got} == {"steady", "gaps", "silent for hours"}
    ordered = carried.select(F.expr("points.t = array_sort(points.t)").alias("o")).distinct().collect()
    assert [r.o for r in ordered] == [True]


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "c")
    make = lambda m: rings.carried_windows(m, CFG, 300)
    land(spark, source, series(0, 250))
    first = rows_of(run(spark, source, out, make))
    assert rows_of(run(spark, source, out, make)) == first  # nothing new: nothing leaves twice
    land(spark, source, series(250, 600))
    both = rows_of(run(spark, source, out, make))
    want = rows_of(run(spark, source, str(tmp_path / "s"), lambda m: streams.sliding_windows(m, CFG, 300)))
    assert both == want and len(both) > len(first) > 0


def test_empty_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    land(spark, source, [])
    assert run(spark, source, str(tmp_path / "c"), lambda m: rings.carried_windows(m, CFG, 300)).count() == 0
