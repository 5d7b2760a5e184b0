"""Rows by their place in an order: over all rows without one task that holds them, and the first few of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import stored

#: ``monotonically_increasing_id`` puts a row's place in its partition below this bit.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` (bigint): each row's number, from 1, in ``order``.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's
    number is its place in its partition behind the rows of all partitions before
    it.  Only one count a partition is summed up.  Rows that ``order`` does not
    tell apart are numbered in any order among themselves.  ``partitions`` is the
    session's number of shuffle partitions unless given.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    laid = stored(laid, "numbered").withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = laid.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return laid.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_place", "_before")


def heads(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], k: int, name: str = "turn") -> DataFrame:
    """The first ``k`` rows of every group in ``order``, with their turn from 1.

    Every task keeps the first ``k`` of its share of a group before anything is
    shuffled, so a group of any size comes down to ``k`` rows a task.
    """
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(name, turn).where(F.col(name) <= k)


def head_lists(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int, value: str, into: str, total: str) -> DataFrame:
    """``key``, the first ``k`` of each group's ``value`` as an array ``into``, and how many rows the group has as ``total``."""
    top = heads(df.select(*key, *order, value) if value not in (*key, *order) else df.select(*key, *order), key, order, k, "_turn")
    lists = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_turn", F.col(value).alias("v")))).alias("_list"))  # k at most
    counts = df.groupBy(*key).agg(F.count("*").alias(total))
    return counts.join(lists, list(key)).select(*key, F.col("_list.v").alias(into), total)
