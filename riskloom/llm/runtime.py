"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset, as
    in local tests, a folder of this machine takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "riskloom-shared")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at files that outlive a lost executor, and later steps
    read only the columns they need.  ``storage.forget`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    storage.remember(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a worker is sent at a time.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def sent_small(df: DataFrame) -> DataFrame:
    """``df``, whose session sends rows to Python by ``BATCH_BYTES``, unless it has a bound of its own.

    By default ten thousand whole texts are sent at once, which each side holds several times.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _UNSET:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def _give_back() -> None:
    """Return to the machine what this worker has freed; both allocators otherwise keep it for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each``, whose worker gives memory back after every batch that it was sent.

    Workers outlive their tasks, and an executor is charged for what they hold while others work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from each(sent())
        _give_back()

    return run


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two longs that name each row, whatever its ids are, and the names of these columns.

    They are a hash of the row's file and its place there, so that they stay
    the same in every read of the same files.  A table that is no plain read
    of files is written first.
    """
    plain = df._jdf.queryExecution().analyzed().children().isEmpty()
    names = [unused_name(df, "row_file"), unused_name(df, "row_place")]
    for rows in (df, None) if plain else (None,):
        rows = materialize(df, "keyed-rows") if rows is None else rows
        try:
            about = rows.metadataColumn("_metadata")
            return rows.select("*", F.xxhash64(about["file_path"]).alias(names[0]), about["row_index"].alias(names[1])), names
        except AnalysisException:
            continue
    raise ValueError("the rows of this table cannot be named")


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df``, under the operator's own names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def without(df: DataFrame, *added: str) -> tuple[list, list[int]]:
    """Fields and places of the columns of ``df`` that stay where columns named ``added`` are put behind them; one of the same name gives way."""
    names = {a.lower() for a in added}
    at = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    return [df.schema.fields[i] for i in at], at
