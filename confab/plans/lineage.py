"""Cutting lineage with tables written to the cluster's shared folder.

Executors can be lost at any time, so nothing an operator reads twice is kept on
executor-local storage only: it is written as Parquet under the folder named by
``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    Read from the session (``spark.checkpoint.dir``, or the context's own
    checkpoint folder). Only where neither is set, as in tests, a temporary
    folder is made and set; a master other than ``local`` has to name one, as its
    executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    master = spark.conf.get("spark.master", None) or "local"
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="confab-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/confab-{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of a plan once it has run: what is written isn't computed again.

    The session gets its own setting back; where another thread is at it, this one goes without.
    """
    if not _writing.acquire(blocking=False):
        yield
        return
    before = spark.conf.get(_DROP_SHUFFLES, None)
    try:
        spark.conf.set(_DROP_SHUFFLES, "true")
        yield
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
        _writing.release()


@contextlib.contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that :func:`cut_lineage` wrote within it, except those behind the frames put on its list.

    For work whose result is collected or written before the end: what it read is of no further use.
    """
    before, kept = {path for _, path in _written}, []
    try:
        yield kept
    finally:
        files = [f for df in kept for f in df.inputFiles()]
        for entry in [e for e in _written if e[1] not in before]:
            if not any(e in f for f in files for e in [entry[1].rsplit("/", 1)[1]]):
                _delete(*entry)
                _written.remove(entry)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the table behind a frame returned by :func:`cut_lineage`."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        for entry in [e for e in _written if path.endswith(e[1].split("://")[-1])]:
            _delete(*entry)
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone; the cluster's own cleaning of the folder applies
            return


atexit.register(_clean)
