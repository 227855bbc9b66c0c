"""Stage results that several later stages read: written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from threading import local

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.

    A fresh local folder is used only where neither is set and the master is local: on a cluster
    executors would write to their own disks and later reads would miss the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark._jsc.sc().getCheckpointDir()
        folder = known.get().rsplit("/", 1)[0] if known.isDefined() else None
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="vigilseries-")


def stage_folder(spark: SparkSession) -> str:
    """Folder of the stage tables of this Spark application."""
    return f"{shared_folder(spark)}/stages/{spark.sparkContext.applicationId}"


_SCOPES = local()  # per thread: micro-batches run in threads of their own


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_SCOPES, "open", [])[-1:]:
        paths.append(path)
    return path


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Stage tables made inside are deleted at the end, for work whose result is stored by then."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        _delete(spark, _SCOPES.open.pop())


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once models and detections are stored. Frames
    that still read them, such as models that were not saved elsewhere, become unusable."""
    _delete(spark, [stage_folder(spark)])


class FileTree:
    """Files below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._files = self._new(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str = "") -> list[str]:
        """What is directly in a folder; nothing if it does not exist."""
        at = self._new(self.path(folder) if folder else self.root)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def read(self, name: str) -> bytes:
        stream = self._files.open(self._new(self.path(name)))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        stream = self._files.create(self._new(self.path(name)), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        """Whether it was renamed; not if ``to`` exists. The draft is gone either way."""
        target = self._new(self.path(to))
        done = not self._files.exists(target) and self._files.rename(self._new(self.path(name)), target)
        if not done:
            self.delete(name)
        return done

    def delete(self, name: str) -> None:
        self._files.delete(self._new(self.path(name)), True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back.

    This cuts the lineage at a place every executor can reach, and gives the planner the real
    size of the table, so it alone decides whether a later join may broadcast it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
