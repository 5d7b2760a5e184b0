"""What reports show of verdicts: counts, crowds, headline, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..plans.storage import by_keys
from .correlate import Campaigns
from .ranks import heads
from .scoring import severity_rank


def severity_counts(verdicts: DataFrame) -> DataFrame:
    """Flagged packages per severity, with a row for each of the four."""
    spark = verdicts.sparkSession
    all_ = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in fixed.SEVERITY_ORDER[1:]])).alias("severity"))
    n = verdicts.where("score > 0").groupBy("severity").agg(F.count("*").alias("n"))
    return all_.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def worst(verdicts: DataFrame) -> DataFrame:
    """One row: the worst severity of all, clean if there is none."""
    return verdicts.agg(F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("clean")).alias("worst"))


def gate(verdicts: DataFrame, fail_on: str, names: int = 4) -> DataFrame:
    """One row: ``exit_code`` (1 if any verdict is at or above a level), how many are, and the first names by score."""
    floor = fixed.SEVERITY_ORDER.index(fail_on) if fail_on in fixed.SEVERITY_ORDER else len(fixed.SEVERITY_ORDER)
    blamed = verdicts.where(severity_rank(F.col("severity")) >= floor)
    top = blamed.orderBy(F.desc("score"), "name").limit(names).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))).alias("t"))
    return blamed.agg(F.count("*").alias("n")).crossJoin(top).select(F.when(F.col("n") > 0, 1).otherwise(0).alias("exit_code"), "n", F.array_join("t.name", ", ").alias("blamed"))


def _alike(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("NOT certain AND severity IN ('low', 'medium', 'high') AND size(findings) > 0").withColumn("rules", F.col("findings.rule_id"))


def crowds(verdicts: DataFrame, least: int = fixed.CROWD_LEAST) -> DataFrame:
    """Uncertain verdicts below critical with the same findings, where there are many: ``rules, n, score, first_name``."""
    found = _alike(verdicts).groupBy("rules").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("name").alias("first_name"))
    return found.where(F.col("n") >= least)


def crowd_names(verdicts: DataFrame, k: int, least: int = fixed.CROWD_LEAST) -> DataFrame:
    """The first ``k`` names of each of ``crowds`` by score, with their turn: ``rules, turn, name, version, score``."""
    many = crowds(verdicts, least).select("rules")
    # The first names are taken before crowds are told from the rest: the other way round all names of a crowd would meet in one task.
    first = heads(_alike(verdicts).select("rules", "name", "version", "score"), ["rules"], [F.desc("score"), F.col("name"), F.col("version")], k)
    return first.join(by_keys(many), "rules", "left_semi").select("rules", "turn", "name", "version", "score")


def crowd_members(verdicts: DataFrame, rules: list[str]) -> DataFrame:
    """All names of one crowd, in order."""
    same = F.array(*[F.lit(r) for r in rules])
    return _alike(verdicts).where(F.col("rules") == same).select("name", "version").orderBy("name", "version")


def at_or_above(severity: str, fail_on: str) -> bool:
    """Whether a severity makes a run fail that fails on another."""
    order = fixed.SEVERITY_ORDER
    return fail_on in order and order.index(severity) >= order.index(fail_on)


def told_singly(verdicts: DataFrame, least: int = fixed.CROWD_LEAST) -> DataFrame:
    """Flagged verdicts that are in no crowd."""
    many = crowds(verdicts, least).select("rules")
    crowded = _alike(verdicts).join(many, "rules", "left_semi").select("pkg_id")
    return verdicts.where("score > 0").join(by_keys(crowded), "pkg_id", "left_anti")


def headline_rule(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """One row, or none: the most alarming rule that fired and how many package names it fired on."""
    order = F.array_position(F.array(*[F.lit(r) for r in fixed.HEADLINE_ORDER]), F.col("rule_id"))
    fired = findings.join(by_keys(packages.select("pkg_id", "name")), "pkg_id").groupBy("rule_id").agg(F.count_distinct("name").alias("n"))
    return fired.where(order > 0).orderBy(order).limit(1)


def top_rule(ruled: DataFrame) -> DataFrame:
    """One row, or none: the heaviest rule that fired; of equals the first id."""
    return ruled.select("rule_id", "weight").distinct().orderBy(F.desc("weight"), "rule_id").limit(1)


def alone_severity(ruled: DataFrame) -> DataFrame:
    """What each package would score without its campaign findings."""
    from .scoring import scores

    return scores(ruled.where("category <> 'campaign'")).select("pkg_id", F.col("score").alias("alone_score"), F.col("severity").alias("alone"))


def campaign_tone(campaigns: Campaigns, verdicts: DataFrame) -> DataFrame:
    """Each campaign's worst member: ``label, tone, members``."""
    held = campaigns.members.join(verdicts.select("pkg_key", "severity"), "pkg_key", "left")
    return held.groupBy("label").agg(F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("clean")).alias("tone"), F.count_distinct("pkg_key").alias("members"))


def campaign_matrix(campaigns: Campaigns) -> DataFrame:
    """``label, pkg_key`` by link kind: how many links of each a member is in."""
    return campaigns.link_members.groupBy("label", "pkg_key").pivot("kind", list(fixed.LINK_KINDS)).agg(F.count("*")).na.fill(0)
