"""Which commits lie in which tags' history, as joins over a table of parents.

Commits are cut into chains: a commit carries on the chain of its first parent if
of all commits that do so the longest line hangs on it.  Within a chain, what a
tag reaches is everything up to some place, so a tag's history is one number for
each chain that it enters.  From all places of a chain that are newly reached,
all links to other chains are followed at once; a main line with ten thousand
merged branches takes two rounds, and only branches off branches take more.

Heights and places in a chain come from pointers that double their reach every
round, so a line of a million commits takes twenty rounds.

Commits have numbers for all this, and a round moves only the commits whose
pointers have not come to an end; tables are dealt out by their keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import by_keys, stored


def _numbers(commits: DataFrame) -> DataFrame:
    """``sha, n``: a number for each commit."""
    return stored(commits.select("sha").distinct().withColumn("n", F.monotonically_increasing_id()), "ancestry-numbers")


def _steps(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``n, up, place``: parents that are commits here by number, each once, at its first place."""
    child = parents.join(by_keys(nodes), "sha").select("n", F.col("parent").alias("sha"), "place")
    met = child.join(by_keys(nodes.withColumnRenamed("n", "up")), "sha").groupBy("n", "up").agg(F.min("place").alias("place"))
    return stored(met, "ancestry-steps")


def _heights(first: DataFrame) -> DataFrame:
    """``first`` (n, up: the first parent) to ``n, height``: how far the longest line above a commit goes; those with neither are left out.

    After each round a commit knows the lines of less than ``reach`` steps above
    it; lines of up to twice that come from the commits ``reach`` steps above.
    Commits with nothing ``reach`` steps below have told all they know and only
    hear from then on.
    """
    heard, reach = [], 1
    telling = first.select("n", F.col("up").alias("below"), F.lit(0).cast("long").alias("height"))
    while not telling.isEmpty():
        told = stored(telling.groupBy(F.col("below").alias("n")).agg((F.max("height") + reach).alias("heard")), f"ancestry-told-{reach}")
        further = telling.select(F.col("n").alias("below"), F.col("below").alias("next"))
        higher = telling.join(by_keys(told), "n", "left").select("n", "below", F.greatest("height", "heard").alias("height"))
        grown = stored(higher.join(by_keys(further), "below", "left").select("n", F.col("next").alias("below"), "height"), f"ancestry-heights-{reach}")
        heard += [told.withColumnRenamed("heard", "height"), grown.where("below IS NULL").select("n", "height")]
        telling = grown.where("below IS NOT NULL")
        reach *= 2
    every = reduce(DataFrame.unionByName, heard) if heard else telling.select("n", "height")
    return every.groupBy("n").agg(F.max("height").alias("height"))


def _placed(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``n, chain, pos`` of all commits; a chain is the number of its lowest commit, which has the place 0."""
    first = steps.where("place = 0").select("n", "up")
    heirs = first.join(by_keys(_heights(first)), "n").groupBy("up").agg(F.max_by("n", "height").alias("n"))
    low = nodes.select("n").join(by_keys(heirs), "n", "left")
    jump = stored(low.select("n", F.coalesce("up", "n").alias("chain"), F.col("up").isNotNull().cast("long").alias("pos")), "ancestry-chains")
    done, reach = [], 1
    # What has not come to its chain's end has gone as far as a pointer goes by now.
    while not jump.where(F.col("pos") == reach).isEmpty():
        beyond = reduce(DataFrame.unionByName, [jump, *done]).select(F.col("n").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"))
        moved = jump.where(F.col("pos") == reach).join(by_keys(beyond), "chain").select("n", F.col("next").alias("chain"), (F.col("pos") + F.col("more")).alias("pos"))
        done.append(jump.where(F.col("pos") < reach))
        reach *= 2
        jump = stored(moved, f"ancestry-chains-{reach}")
    return reduce(DataFrame.unionByName, [jump, *done])


def chains(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """``commits`` (sha) and ``parents`` (sha, parent, place from 0) to ``sha, chain, pos``.

    A chain is named by its lowest commit, which has the place 0.  Parents that
    are no commits here, as beyond the end of a shallow clone, are none.
    """
    nodes = _numbers(commits)
    placed = _placed(nodes, _steps(nodes, parents)).join(by_keys(nodes), "n")
    return placed.join(by_keys(nodes.select(F.col("n").alias("chain"), F.col("sha").alias("name"))), "chain").select("sha", F.col("name").alias("chain"), "pos")


def _links(placed: DataFrame, steps: DataFrame) -> DataFrame:
    """``chain, pos, to_chain, to_pos``: from commits to their parents on other chains."""
    child = steps.select("n", "up").join(by_keys(placed), "n").select("up", "chain", "pos")
    parent = placed.select(F.col("n").alias("up"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    return child.join(by_keys(parent), "up").where("chain <> to_chain").select("chain", "pos", "to_chain", "to_pos")


def _tag_reach(placed: DataFrame, steps: DataFrame, tags: DataFrame) -> DataFrame:
    """``tag, chain, top``: for each of ``tags`` (tag, n) the chains that its history enters, and the highest place there.

    ``placed`` is a table of ``_placed``.
    """
    links = stored(_links(placed, steps), "ancestry-links")
    own = tags.join(by_keys(placed), "n").groupBy("tag", "chain").agg(F.max("pos").alias("top"))
    reach, turn = stored(own.select("tag", "chain", "top", F.lit(-1).cast("long").alias("below")), "ancestry-reach"), 0
    while not (new := reach.where("top > below")).isEmpty():
        turn += 1
        met = new.join(by_keys(links), "chain").where((F.col("pos") > F.col("below")) & (F.col("pos") <= F.col("top")))
        heard = met.select("tag", F.col("to_chain").alias("chain"), F.col("to_pos").alias("top"), F.lit(-1).cast("long").alias("below"))
        known = reach.select("tag", "chain", "top", F.col("top").alias("below"))
        merged = heard.unionByName(known).groupBy("tag", "chain").agg(F.max("top").alias("top"), F.max("below").alias("below"))
        reach = stored(merged, f"ancestry-reach-{turn}")
    return reach.select("tag", "chain", "top")


def tags_containing(commits: DataFrame, parents: DataFrame, tags: DataFrame, asked: DataFrame) -> DataFrame:
    """``(sha, tag)``: the ``tags`` (tag, sha) whose history holds each commit of ``asked`` (sha), the tagged commit itself included."""
    nodes = _numbers(commits)
    steps = _steps(nodes, parents)
    placed = _placed(nodes, steps)
    reach = _tag_reach(placed, steps, tags.join(by_keys(nodes), "sha").select("tag", "n"))
    own = nodes.join(by_keys(asked.select("sha")), "sha", "left_semi").join(by_keys(placed), "n")
    return own.join(by_keys(reach), "chain").where("pos <= top").select("sha", "tag")
