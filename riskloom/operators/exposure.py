"""How long a version sat in the lockfile: spans of presence over a series of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spans(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (idx, ecosystem, name, version) to gapless runs: ``first, last, commits``.

    Within a run the index less its rank stays the same, so runs are groups.
    """
    key = ["ecosystem", "name", "version"]
    present = snapshots.select("idx", *key).distinct()
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*key).orderBy("idx"))
    return present.withColumn("island", island).groupBy(*key, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("commits")).drop("island")


def windows(snapshots: DataFrame, commits: DataFrame, as_of: Column) -> DataFrame:
    """Spans with the commits that opened and closed them, and their length in days.

    ``left_*`` are null while a version is still there; ``bounded`` is false if
    it was there in the first commit read.
    """
    found = spans(snapshots)
    entered = commits.select(F.col("idx").alias("first"), F.col("sha").alias("entered_sha"), F.col("when").alias("entered"), F.col("subject").alias("entered_subject"))
    left = commits.select((F.col("idx") - 1).alias("last"), F.col("sha").alias("left_sha"), F.col("when").alias("left_at"), F.col("subject").alias("left_subject"))
    out = found.join(entered, "first").join(left, "last", "left")
    ended = F.coalesce(F.col("left_at"), as_of)
    days = F.greatest(F.lit(0.0), (F.unix_micros(ended) - F.unix_micros("entered")) / 86_400e6)
    return out.withColumns({"bounded": F.col("first") > 0, "open": F.col("left_sha").isNull(), "days": days})


def with_intel(windows_: DataFrame, intel: DataFrame) -> DataFrame:
    """Windows with what is reported of their version, and their severity."""
    from ..sources.feeds import advisory_name

    known = intel.select("ecosystem", F.col("name").alias("feed_name"), "version", "malware", "advisories")
    joined = windows_.withColumn("feed_name", advisory_name()).join(known, ["ecosystem", "feed_name", "version"], "left").drop("feed_name")
    bad, warned = F.coalesce(F.size("malware"), F.lit(0)) > 0, F.coalesce(F.size("advisories"), F.lit(0)) > 0
    return joined.withColumn("severity", F.when(bad, "critical").when(warned, "medium").otherwise("clean"))


def reported(windows_: DataFrame, package: str = "") -> DataFrame:
    """The windows to report: those of a named package, by part of its name, else those known to be bad."""
    if package:
        return windows_.where(F.lower("name").contains(package.lower()))
    return windows_.where("severity <> 'clean'")


def report_order(windows_: DataFrame) -> DataFrame:
    """Malware first, then advisories, then by entry."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return windows_.orderBy(rank, "entered", "name", "version")


def tags_during(windows_: DataFrame, tags: DataFrame) -> DataFrame:
    """``tags`` (sha, tag: contains) to each window's tags: those that hold its entry and not its end."""
    key = ["ecosystem", "name", "version", "first"]
    during = windows_.join(tags.withColumnRenamed("sha", "entered_sha"), "entered_sha").select(*key, "left_sha", "tag")
    after = tags.select(F.col("sha").alias("left_sha"), "tag")
    kept = during.join(after, ["left_sha", "tag"], "left_anti")
    return windows_.join(kept.groupBy(*key).agg(F.array_sort(F.collect_set("tag")).alias("tags")), key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def axis_share(when: Column, first: Column, last: Column) -> Column:
    """Where a moment lies between two others, from 0 to 1."""
    total = F.unix_micros(last) - F.unix_micros(first)
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.unix_micros(when) - F.unix_micros(first)) / total))).otherwise(0.0)


def summary(every: DataFrame, reported_: DataFrame) -> DataFrame:
    """One row: distinct versions ever pinned, of them exposed to malware, and with advisories only."""
    coords = every.agg(F.count_distinct("ecosystem", "name", "version").alias("versions"))
    coord = F.concat("name", F.lit("@"), "version")
    bad = reported_.agg(F.count_distinct(F.when(F.col("severity") == "critical", coord)).alias("exposed"), F.count_distinct(F.when(F.col("severity") != "clean", coord)).alias("flagged"))
    return coords.crossJoin(bad).select("versions", "exposed", (F.col("flagged") - F.col("exposed")).alias("with_advisories"))


#: What to do about a window, by whether its version is malware and still there.
REMEDIES = {
    "open": "It is still pinned: remove it, then replace every credential that an install could read, those of CI first.",
    "past": "It is gone, but what an install could read in that time was exposed: replace every such credential.",
    "advisory": "Move past the versions that the advisory names.",
}


def remedy() -> Column:
    """What a window calls for, null if nothing."""
    return F.when(F.col("severity") == "critical", F.when(F.col("open"), REMEDIES["open"]).otherwise(REMEDIES["past"])).when((F.col("severity") == "medium") & F.col("open"), REMEDIES["advisory"])


def longest_exposure(reported_: DataFrame) -> DataFrame:
    """One row, or none: the window in which malware stayed longest, and how many versions were exposed."""
    bad = reported_.where("severity = 'critical'")
    coord = F.concat("name", F.lit("@"), "version")
    worst = F.max_by(F.struct("ecosystem", "name", "version", "entered", "left_at", "days", "open"), F.struct("days", "name", "version"))
    return bad.groupBy().agg(F.count_distinct(coord).alias("versions"), worst.alias("worst")).where("versions > 0").select("versions", "worst.*")
