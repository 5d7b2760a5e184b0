"""URL filters by a sorted sweep over rule intervals.

A rule (host, path) covers the keys that begin with its reversed host and its
path.  A page asks once for its host and once for every domain above it, as far
up as any rule's host goes; under one host, a rule is then an interval of
paths.  Rules and pages are sorted together by host and path; the sweep keeps a
stack of the rules it is inside of, of which each page gets the top.  Both ends
of an interval say what is on top from there on, so the stack needs no state
beyond the last end seen.  Hosts with very many pages are dealt to several
sweeps, and each gets the rules of that host.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import narrow, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased in A-Z, and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` tuples as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).selectExpr("'' AS verdict", "'' AS host", "'' AS path")


def _ends(rules: DataFrame) -> DataFrame:
    """``(site, at, top)``: from ``at`` on, ``top`` is the innermost rule of the site, or has a null rule."""
    own = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of two verdicts for one rule, block
        .select(F.array_join(_labels(F.col("host")), ".").alias("site"), "host", "path", "verdict")
    )
    top = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    own = own.select("site", "path", top.alias("top"))
    shorter = own.where(F.length("path") > 0).select("site", "path", F.explode(F.expr("transform(sequence(0, length(path) - 1), i -> left(path, i))")).alias("prefix"))
    outer = own.select(F.col("site").alias("s"), F.col("path").alias("prefix_of"), F.col("top").alias("outer"))
    around = shorter.join(outer, (F.col("site") == F.col("s")) & (F.col("prefix") == F.col("prefix_of"))).groupBy("site", "path").agg(F.max("outer").alias("outer"))
    none = F.expr("named_struct('length', 0, 'host_length', 0, 'rule', cast(null AS string), 'verdict', cast(null AS string))")
    joined = own.join(around, ["site", "path"], "left")
    key = F.encode("path", "utf-8")
    begins = joined.select("site", key.alias("at"), "top")
    closes = joined.select("site", F.concat(key, F.unhex(F.lit("FF"))).alias("at"), F.coalesce("outer", none).alias("top"))  # FF: after every longer path
    return begins.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and every host below it if the path begins with the
    rule's; the longest (host and path together, then host) wins.  Pages that no rule fits,
    among them those with a null or odd URL, have a null rule and the verdict
    ``otherwise``.  Repeated pages and rules, extra columns and empty tables are
    fine; a rule with a null part fits nothing.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parsed = narrow(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    ends = _ends(rules)
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("deepest"))
    asked = parsed.where("host <> ''").select("host", "path").distinct().crossJoin(F.broadcast(deepest))  # one row
    upto = F.least(F.size(_labels(F.col("host"))), F.col("deepest"))
    site = F.expr("transform(sequence(1, upto), i -> array_join(slice(labels, 1, i), '.'))")
    asked = asked.withColumn("labels", _labels(F.col("host"))).withColumn("upto", upto).where("upto > 0").select("host", "path", F.explode(site).alias("site"))
    asked = asked.join(ends.select("site").distinct(), "site", "left_semi")

    # A site's pages are dealt to as many sweeps as its share of all pages asks for.
    sweeps = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    counts = asked.groupBy("site").agg(F.count("*").alias("n"))
    share = F.ceil(F.col("n") * sweeps / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = counts.select("site", share.cast("int").alias("sweeps"))
    asked = asked.join(share, "site").withColumn("sweep", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int")).drop("sweeps")
    opened = ends.join(share, "site").withColumn("sweep", F.explode(F.expr("sequence(0, sweeps - 1)"))).drop("sweeps")

    events = asked.withColumn("at", F.encode("path", "utf-8")).unionByName(opened, allowMissingColumns=True)
    order = Window.partitionBy("site", "sweep").orderBy("at", F.col("top").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = events.withColumn("innermost", F.last("top", ignorenulls=True).over(order)).where("host IS NOT NULL AND innermost.rule IS NOT NULL")
    best = inside.groupBy("host", "path").agg(F.max("innermost").alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the five rules."""
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE = f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS line,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parsed AS (
  SELECT page_id, line,
         translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (VALUES {_VALUES}),
fits AS (
  SELECT line, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY line ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS r
  FROM parsed JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.line = f.line AND f.r = 1
"""
