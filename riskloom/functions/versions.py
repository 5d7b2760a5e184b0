"""Version numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = r"^v?(\d+)\.(\d+)\.(\d+)$"


def triple(version: Column) -> Column:
    """Three numbers of a plain version; null for prereleases and other forms."""
    return F.when(version.rlike(_PLAIN), F.struct(*[F.regexp_extract(version, _PLAIN, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def newest(releases: DataFrame, key: str = "name", version: str = "version") -> DataFrame:
    """The highest plain version of each key."""
    return releases.where(triple(F.col(version)).isNotNull()).groupBy(key).agg(F.max_by(version, triple(F.col(version))).alias(version))


def advisory_ids(text: Column) -> Column:
    """Ids of advisories in a text."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:GHSA(?:-[0-9a-z]{4}){3}|CVE-\d{4}-\d{4,}|MAL-\d{4}-\d+|PYSEC-\d{4}-\d+)\b"), F.lit(0))
