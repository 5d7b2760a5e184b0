"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, as in local runs, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "riskloom-shared")


_written: list[str] = []


def written() -> int:
    """How many tables this process has written so far: a mark for ``forget``."""
    return len(_written)


def remember(path: str) -> None:
    """Note a folder that ``forget`` may delete."""
    _written.append(path)


def forget(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete the tables written after a mark but those of labels in ``keep``, once nothing that reads them is wanted; how many went."""
    gone = [p for p in _written[since:] if not os.path.basename(p).startswith(keep or ("\x00",))]
    _written[since:] = [p for p in _written[since:] if p not in set(gone)]
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(paths.Path, gone):
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


#: Deletes what a query shuffled when it ends; left to Spark it stays on disk until its garbage is collected.
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, so that loops do not grow its plan and a lost executor costs nothing.

    What the write shuffles is deleted as it ends.  The table stays until ``forget``, as what comes back is read only when its own result is asked for.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    remember(path)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP_SETTING, "false")
    conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_keys(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both sides out by their keys.

    Left to itself Spark goes by the size on disk, where millions of ids may be
    packed into a few MB, and sends them whole through the driver to all.
    """
    return df.hint("merge")


#: Bytes of rows that a Python worker is sent at a time.
_BATCH_BYTES = 1 << 20
_BATCH_SETTING, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def sent_small(df: DataFrame) -> DataFrame:
    """``df``, whose session sends rows to Python by ``_BATCH_BYTES``, unless it has a bound of its own; by default ten thousand whole texts are parsed at once."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _UNSET:
        conf.set(_BATCH_SETTING, str(_BATCH_BYTES))
    return df
