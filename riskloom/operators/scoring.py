"""Scores: weights by category, summed, raised where categories agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..plans.storage import by_keys


def severity(score: Column) -> Column:
    out = F.when(score >= fixed.SEVERITIES[0][0], fixed.SEVERITIES[0][1])
    for floor, name in fixed.SEVERITIES[1:]:
        out = out.when(score >= floor, name)
    return out.otherwise("clean")


def severity_rank(name: Column) -> Column:
    """Place of a severity from clean (0) to critical (4)."""
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITY_ORDER]), name) - 1


def category_scores(findings: DataFrame) -> DataFrame:
    """``findings`` (pkg_id, category, weight, certain) to ``(pkg_id, category, part, certain)``.

    The heaviest finding counts in full, the others by a share; halves round to the even number.
    """
    heaviest, all_ = F.max("weight"), F.sum("weight")
    part = F.bround(heaviest + fixed.REST_SHARE * (all_ - heaviest)).cast("int")
    return findings.groupBy("pkg_id", "category").agg(part.alias("part"), F.max("certain").alias("certain"))


def _part(weights: Column) -> Column:
    """A category's part of a score, of the weights of its findings: the heaviest in full, a share of the others."""
    heaviest, all_ = F.array_max(weights), F.aggregate(weights, F.lit(0).cast("long"), lambda s, w: s + w)
    return F.bround(heaviest + fixed.REST_SHARE * (all_ - heaviest)).cast("int")


def _scored(found: DataFrame, *keep: str) -> DataFrame:
    """``found`` (pkg_id, found: an array of category, weight and certain) with its score, in the row."""
    category = lambda f: f["category"]
    kinds = F.array_sort(F.array_distinct(F.transform("found", category)))
    entry = lambda c: F.struct(c.alias("category"), _part(F.transform(F.filter("found", lambda f: f["category"] == c), lambda f: f["weight"])).alias("part"))
    rows = found.select("pkg_id", *keep, F.transform(kinds, entry).alias("entries"), F.exists("found", lambda f: f["certain"]).alias("certain"))
    total = F.aggregate("entries", F.lit(0), lambda s, e: s + e["part"])
    rows = rows.withColumns({"sum": total, "raised": 1.0 + fixed.CATEGORY_BONUS * (F.size("entries") - 1)})
    sure = F.col("certain")
    score = F.when(sure, 100).otherwise(F.least(F.lit(100), F.bround(F.col("sum") * F.col("raised")).cast("int")))
    return rows.select(
        "pkg_id",
        *keep,
        score.alias("score"),
        F.when(sure, 100).otherwise(F.col("sum")).alias("base"),
        F.when(sure, 1.0).otherwise(F.col("raised")).alias("multiplier"),
        F.col("entries.category").alias("categories"),
        F.when(~sure, F.map_from_entries("entries")).otherwise(F.create_map().cast("map<string,int>")).alias("parts"),
        "certain",
        severity(score).alias("severity"),
    )


def scores(findings: DataFrame) -> DataFrame:
    """One row per package with findings: ``pkg_id, score, base, multiplier, categories, parts, certain, severity``.

    A package's findings, a few dozen at most, meet in one aggregate, and its
    categories are worked out in the row; a certain finding settles the score.
    """
    return _scored(findings.groupBy("pkg_id").agg(F.collect_list(F.struct("category", "weight", "certain")).alias("found")))


def with_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with their rules' columns; the rule table has a row per rule and is broadcast by its size."""
    return findings.join(F.broadcast(rules), "rule_id")


def verdicts(packages: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Every package with its score and findings, the certain and heaviest first: one aggregate and one join."""
    ruled = with_rules(findings, rules)
    order = F.struct((~F.col("certain")).alias("later"), (-F.col("weight")).alias("lighter"), "rule_id", "title", "category", "weight", "evidence", "fix", F.col("certain").alias("sure"))
    listed = ruled.groupBy("pkg_id").agg(F.sort_array(F.collect_list(order)).alias("found"))
    shown = F.transform("found", lambda f: F.struct(f["rule_id"].alias("rule_id"), f["title"].alias("title"), f["category"].alias("category"), f["weight"].alias("weight"), f["evidence"].alias("evidence"), f["fix"].alias("fix")))
    marked = F.transform("found", lambda f: F.struct(f["category"].alias("category"), f["weight"].alias("weight"), f["sure"].alias("certain")))
    scored = packages.join(by_keys(_scored(listed.select("pkg_id", shown.alias("findings"), marked.alias("found")), "findings")), "pkg_id", "left")
    empty = F.expr("cast(array() AS array<struct<rule_id:string,title:string,category:string,weight:int,evidence:array<string>,fix:string>>)")
    return scored.withColumns(
        {
            "score": F.coalesce("score", F.lit(0)),
            "base": F.coalesce("base", F.lit(0)),
            "multiplier": F.coalesce("multiplier", F.lit(1.0)),
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
            "parts": F.coalesce("parts", F.create_map().cast("map<string,int>")),
            "certain": F.coalesce("certain", F.lit(False)),
            "severity": F.coalesce("severity", F.lit("clean")),
            "findings": F.coalesce("findings", empty),
        }
    )


def arithmetic() -> Column:
    """How a verdict's score came about, in one line."""
    by_weight = F.array_sort(F.map_entries("parts"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    terms = F.array_join(F.transform(by_weight, lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), " + ")
    capped = F.when(F.bround(F.col("base") * F.col("multiplier")) > 100, " capped").otherwise("")
    raised = F.concat(terms, F.lit(" = "), F.col("base").cast("string"), F.lit("  x"), F.format_string("%.2f", F.col("multiplier")), F.lit(" ("), F.size("parts").cast("string"), F.lit(" categories agree)  ->  "), F.col("score").cast("string"), capped)
    plain = F.concat(terms, F.lit(" -> "), F.col("score").cast("string"))
    return F.when(F.size("findings") == 0, "0").when(F.col("certain"), "reported malicious, so no score was calculated").when(F.col("multiplier") == 1.0, plain).otherwise(raised)


def ordered(verdict_rows: DataFrame) -> DataFrame:
    """Verdicts as reports list them: by score, then name."""
    return verdict_rows.orderBy(F.desc("score"), "name", "pkg_id")
