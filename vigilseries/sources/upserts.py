"""A store of detections in which later rows overwrite earlier ones.

Every write adds a folder with one directory per day. A manifest lists, for each day, the compacted
directory and those written since; it is a small file under the next number and is put in place by a
rename, so a reader sees all of a write or nothing of it, and of two writers one tries again. Readers
merge the directories of the days they want. Compaction rewrites the days that were written to and
no others; directories that a manifest no longer lists stay for readers that are on their way until
``vacuum`` deletes them. Forgetting old days changes the manifest only.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseries.functions.columns import utc_day
from vigilseries.functions.storage import FileTree
from vigilseries.sources.store import DETECTION_SCHEMA, latest

Days = dict[str, dict[str, list[str]]]  # day -> {"base": [at most one], "deltas": [...]}


def _manifests(files: FileTree) -> list[str]:
    return sorted(n for n in files.names("manifests") if n.endswith(".json"))


def _current(files: FileTree) -> tuple[int, Days]:
    names = _manifests(files)
    if not names:
        return 0, {}
    return int(names[-1].removesuffix(".json")), json.loads(files.read(f"manifests/{names[-1]}"))


def _change(files: FileTree, change) -> Days:
    """Put ``change(days)`` in place of the current manifest, again if somebody else was faster."""
    while True:
        number, days = _current(files)
        new = {d: of for d, of in change(days).items() if of["base"] or of["deltas"]}
        draft = f"manifests/{uuid.uuid4().hex}.draft"
        files.write(draft, json.dumps(new).encode())
        if files.rename(draft, f"manifests/{number + 1:012d}.json"):
            return new


def _write(rows: DataFrame, files: FileTree, kind: str) -> dict[str, str]:
    """New directories by day."""
    folder = f"{kind}-{uuid.uuid4().hex}"
    dated = rows.select(*DETECTION_SCHEMA.names, utc_day(F.unix_seconds("time")).cast("string").alias("day"))
    dated.hint("rebalance", "day").write.partitionBy("day").parquet(files.path(folder))
    return {n.removeprefix("day="): f"{folder}/{n}" for n in files.names(folder) if n.startswith("day=")}


def _rows(spark: SparkSession, files: FileTree, days: Days) -> DataFrame:
    paths = [files.path(p) for of in days.values() for p in (*of["base"], *of["deltas"])]
    if not paths:
        return spark.createDataFrame([], DETECTION_SCHEMA)
    return spark.read.schema(DETECTION_SCHEMA).parquet(*paths)


def upsert(detections: DataFrame, path: str, written: int | None = None) -> None:
    """Add detections; ``written`` orders writes where the rows have no such column of their own."""
    rows = detections if written is None else detections.withColumn("written", F.lit(written).cast("long"))
    files = FileTree(rows.sparkSession, path)
    added = _write(rows, files, "delta")

    def change(days: Days) -> Days:
        new = {d: {"base": [*of["base"]], "deltas": [*of["deltas"]]} for d, of in days.items()}
        for day, folder in added.items():
            new.setdefault(day, {"base": [], "deltas": []})["deltas"].append(folder)
        return new

    _change(files, change)


def entries(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All rows that may count, overwritten ones included, of the days of ``[first, last]`` (epoch
    seconds). The read-back queries merge them after their own filters."""
    files = FileTree(spark, path)
    day = lambda s: date.fromordinal(date(1970, 1, 1).toordinal() + s // 86_400).isoformat()
    days = {
        d: of for d, of in _current(files)[1].items()
        if (first is None or d >= day(first)) and (last is None or d <= day(last))
    }
    return _rows(spark, files, days)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What was not overwritten."""
    return latest(entries(spark, path))


def compact(spark: SparkSession, path: str) -> int:
    """Merge the days written to since the last time; how many these were."""
    files = FileTree(spark, path)
    due = {d: of for d, of in _current(files)[1].items() if of["deltas"]}
    if not due:
        return 0
    merged = _write(latest(_rows(spark, files, due)), files, "base")

    def change(days: Days) -> Days:
        new = dict(days)
        for day, of in due.items():
            if day in days:  # not forgotten meanwhile
                later = [x for x in days[day]["deltas"] if x not in of["deltas"]]
                new[day] = {"base": [merged[day]], "deltas": later}
        return new

    _change(files, change)
    return len(due)


def forget(spark: SparkSession, path: str, before: str) -> None:
    """Leave out all days before one (``YYYY-MM-DD``). Nothing is read or rewritten."""
    _change(FileTree(spark, path), lambda days: {d: of for d, of in days.items() if d >= before})


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what only manifests before the current one list; no reader may still use those."""
    files = FileTree(spark, path)
    names = _manifests(files)
    listed = lambda days: {p for of in days.values() for p in (*of["base"], *of["deltas"])}
    kept = listed(_current(files)[1])
    for name in names[:-1]:
        for gone in listed(json.loads(files.read(f"manifests/{name}"))) - kept:
            files.delete(gone)
        files.delete(f"manifests/{name}")
