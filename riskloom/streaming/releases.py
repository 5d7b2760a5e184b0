"""A stream of releases against the packages that a project pins.

The feed is append-only; a release that is told again within the watermark is
dropped, and the rest join the pinned packages, a static table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import pep503


def new_releases(feed: DataFrame, pinned: DataFrame, late: str = "2 hours") -> DataFrame:
    """``feed`` (ecosystem, name, version, published_at timestamp) to releases of pinned packages, each once."""
    key = F.when(F.col("ecosystem") == "pypi", pep503(F.col("name"))).otherwise(F.col("name"))
    once = feed.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["ecosystem", "name", "version"])
    ours = pinned.select("ecosystem", key.alias("key"), F.col("version").alias("pinned")).distinct()
    return once.withColumn("key", key).join(ours, ["ecosystem", "key"]).drop("key")


def bursts(feed: DataFrame, window: str = "72 hours", slide: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Releases per publisher and sliding window: ``window, publisher, packages, releases``."""
    counted = feed.withWatermark("published_at", late).groupBy(F.window("published_at", window, slide), "publisher")
    return counted.agg(F.approx_count_distinct("name").alias("packages"), F.count("*").alias("releases"))
