"""The folder that driver and executors share, for tables between steps and the state of streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that new_folder() named, of all sessions of this driver.
_NAMED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; on one machine, as in tests, a folder of its own where nothing is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file:///tmp/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for a table or a stream; discard() removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _NAMED.append(path)
    return path


def discard(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Remove the folders given, or all that new_folder() named, once the results that stand on them are written elsewhere; gives how many
    were there."""
    gone, jvm = 0, spark._jvm
    for name in list(_NAMED if paths is None else paths):
        if name in _NAMED:
            _NAMED.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written here go when it is there, not when the driver happens to collect its garbage; the session's
    own setting comes back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so several uses and lost executors cost no work again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
