"""What changed between two sets of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(base: DataFrame, head: DataFrame, order: str = "pkg_id") -> DataFrame:
    """Full outer join on ecosystem and name: ``ecosystem, name, change, was, now, head_id``.

    ``change`` is added, updated, unchanged or removed.  Of several base rows of
    one name the last by ``order`` counts; of several head rows the first is
    compared with it and the others are added.
    """
    at = lambda c: F.when(F.coalesce(F.col("version"), F.lit("")) != "", F.col("version")).otherwise(F.col("spec")).alias(c)
    key = ["ecosystem", "name"]
    old = base.where("kind = 'package'").groupBy(*key).agg(F.max_by(F.struct(at("was")), order).alias("b")).select(*key, "b.was", F.lit(True).alias("in_base"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    new = head.where("kind = 'package'").select(*key, at("now"), F.col("pkg_id").alias("head_id"), turn.alias("turn"), F.lit(True).alias("in_head"))
    both = old.withColumn("turn", F.lit(1)).join(new, [*key, "turn"], "full_outer")
    change = (
        F.when(F.col("in_base").isNull(), "added")
        .when(F.col("in_head").isNull(), "removed")
        .when(F.col("was").eqNullSafe(F.col("now")), "unchanged")
        .otherwise("updated")
    )
    return both.select(*key, change.alias("change"), "was", "now", "head_id")
