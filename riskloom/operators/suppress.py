"""Findings that are ignored by policy or accepted by a baseline."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import glob_regex
from ..plans.storage import by_keys
from ..sources.settings import Ignore


def ignored(ignores: Iterable[Ignore], rule: Column, name: Column) -> Column:
    """Whether any of a policy's ignores, a handful of globs, covers a finding."""
    out = F.lit(False)
    for i in ignores:
        out = out | (rule.rlike(glob_regex(i.rule)) & name.rlike(glob_regex(i.package)))
    return out


def apply_ignores(findings: DataFrame, packages: DataFrame, ignores: Iterable[Ignore]) -> tuple[DataFrame, DataFrame]:
    """Findings that are left and findings that are suppressed."""
    ignores = list(ignores)
    if not ignores:
        return findings, findings.where("false")
    named = findings.join(by_keys(packages.select("pkg_id", "name")), "pkg_id")
    hit = ignored(ignores, F.col("rule_id"), F.col("name"))
    return named.where(~hit).drop("name"), named.where(hit).drop("name")


def fingerprint() -> Column:
    """How a baseline names a finding: ``ecosystem:name@version:rule``, with the spec or ``*`` for a missing version."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.concat(F.col("ecosystem"), F.lit(":"), F.col("name"), F.lit("@"), F.coalesce(blank("version"), blank("spec"), F.lit("*")), F.lit(":"), F.col("rule_id"))


def fingerprints(findings: DataFrame, packages: DataFrame) -> DataFrame:
    named = findings.join(by_keys(packages.select("pkg_id", "ecosystem", "name", "version", "spec")), "pkg_id")
    return named.withColumn("fingerprint", fingerprint())


def apply_baseline(findings: DataFrame, packages: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that a baseline (fingerprint) does not know, and those it does."""
    named = fingerprints(findings, packages)
    known = accepted.select("fingerprint").distinct()
    columns = findings.columns
    return named.join(by_keys(known), "fingerprint", "left_anti").select(*columns), named.join(by_keys(known), "fingerprint", "left_semi").select(*columns)
