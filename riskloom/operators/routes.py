"""Dependency edges and the routes by which a package came in."""

from __future__ import annotations

import json
import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import pep503
from ..plans.storage import by_keys, sent_small, stored
from .ranks import heads, numbered


def resolved_edges(entries: DataFrame) -> DataFrame:
    """What each entry of flat lockfiles gets for every name it asks for.

    ``entries`` (project, origin, path, entry) to ``ecosystem, project, origin,
    parent_path, parent, child, child_path, version``; the project itself has the
    path ``''`` and a null parent.  A name resolves to the copy in the nearest
    enclosing ``node_modules``: every folder on the way up is a candidate key of
    an equality join, and of those that exist the deepest is kept, by a maximum
    that tasks take before they shuffle.  Names found nowhere give no edge.
    Lockfiles are parsed once, and what is needed of their entries is stored.
    """
    e = F.col("entry")
    none = F.array().cast("array<string>")
    names = [F.coalesce(F.map_keys(e[k]), none) for k in ("dependencies", "optionalDependencies", "peerDependencies")]
    own = F.coalesce(F.when(e["name"] != "", e["name"]), F.substring_index("path", "node_modules/", -1))
    at = ("project", "origin", "path")
    known = entries.select(*at, F.when(F.col("path") != "", own).alias("parent"), e["version"].alias("version"), F.array_distinct(F.concat(*names)).alias("names"))
    known = stored(known, "routes-entries")
    wanted = known.select(*at, "parent", F.explode("names").alias("child"))
    parts = F.split("path", "/node_modules/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/node_modules/"))
    tried = wanted.select("*", F.posexplode(F.array_distinct(F.concat(F.array(F.lit("")), folders))).alias("depth", "folder"))
    found = F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit("node_modules/"), F.col("child"))
    there = known.select("project", "origin", F.col("path").alias("found"), "version")
    met = tried.withColumn("found", found).drop("folder").join(by_keys(there), ["project", "origin", "found"])
    nearest = met.groupBy(*at, "parent", "child").agg(F.max_by(F.struct("found", "version"), "depth").alias("copy"))
    return nearest.select(F.lit("npm").alias("ecosystem"), "project", "origin", F.col("path").alias("parent_path"), "parent", "child", F.col("copy.found").alias("child_path"), F.col("copy.version").alias("version"))


def lock_edges(entries: DataFrame) -> DataFrame:
    """Edges of flat lockfiles by name: ``ecosystem, parent, child``; a null parent is the project."""
    return resolved_edges(entries).select("ecosystem", "parent", "child").distinct()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("parent", T.StringType()), T.StructField("child", T.StringType())])))
def _tree(text: pd.Series) -> pd.Series:
    def read(t: str | None) -> list[dict]:
        try:
            doc = json.loads(t or "")
            if any((doc.get("packages") or {}).keys()):
                return []
            out, todo = [], [(None, doc.get("dependencies") or {})]
            while todo:
                parent, entries = todo.pop()
                for name, e in entries.items():
                    out.append({"parent": parent, "child": name})
                    out += [{"parent": name, "child": c} for c in e.get("requires") or {}]
                    todo.append((name, e.get("dependencies") or {}))
            return out
        except (ValueError, AttributeError, TypeError):
            return []

    return pd.Series([read(t) for t in text], dtype=object)


def tree_edges(texts: DataFrame) -> DataFrame:
    """Edges of nested lockfiles: from each package to what it holds and to what it requires; a null parent is the project.

    Manifests that are no such lockfile give none.
    """
    locks = texts.where(F.col("basename").isin("package-lock.json", "npm-shrinkwrap.json"))
    return sent_small(locks).select(F.explode(_tree("text")).alias("e")).select(F.lit("npm").alias("ecosystem"), "e.parent", "e.child").distinct()


def poetry_edges(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entries`` (name, dependencies) to edges among declared packages, and roots: declared but depended on by none."""
    declared = entries.select(pep503(F.col("name")).alias("name")).where("name <> ''").distinct()
    edges = entries.select(pep503(F.col("name")).alias("parent"), F.explode("dependencies").alias("child")).select("parent", pep503(F.col("child")).alias("child"))
    edges = edges.join(by_keys(declared.withColumnRenamed("name", "child")), "child", "left_semi").select(F.lit("pypi").alias("ecosystem"), "parent", "child").distinct()
    return edges, wanted_by_none(declared, edges).select(F.lit("pypi").alias("ecosystem"), "name")


def wanted_by_none(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct names of ``declared`` (name) that are the child of no edge (parent, child); each table comes down to its names before it is dealt out."""
    children = edges.select(F.col("child").alias("name")).distinct()
    return declared.select("name").distinct().join(by_keys(children), "name", "left_anti")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StringType()))])))
def _poetry(text: pd.Series) -> pd.Series:
    def read(t: str | None) -> list[dict]:
        try:
            found = tomllib.loads(t or "").get("package") or []
            return [{"name": str(p.get("name") or ""), "dependencies": list(p.get("dependencies") or {})} for p in found]
        except (tomllib.TOMLDecodeError, AttributeError, TypeError):
            return []

    return pd.Series([read(t) for t in text], dtype=object)


def poetry_text_edges(texts: DataFrame) -> DataFrame:
    """Edges of poetry lockfiles; what no package there depends on was asked for by the project and has a null parent."""
    entries = texts.where("basename = 'poetry.lock'").select(F.explode(_poetry("text")).alias("p")).select("p.name", "p.dependencies")
    edges, roots = poetry_edges(stored(entries, "poetry-entries"))
    return edges.unionByName(roots.select("ecosystem", F.lit(None).cast("string").alias("parent"), F.col("name").alias("child")))


def manifest_edges(texts: DataFrame, lock_entries: DataFrame) -> DataFrame:
    """All edges that manifests tell of: flat and nested lockfiles and those of poetry; ``lock_entries`` are the flat ones' entries."""
    return lock_edges(lock_entries).unionByName(tree_edges(texts)).unionByName(poetry_text_edges(texts)).distinct()


def roots_of(edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """The packages that a project asks for itself."""
    own = edges.where("parent IS NULL").select("ecosystem", F.col("child").alias("name"))
    if packages is not None:
        own = own.unionByName(packages.where("direct AND kind = 'package'").select("ecosystem", "name"))
    return own.distinct()


def _reaching(steps: DataFrame, targets: DataFrame, longest: int) -> DataFrame:
    """The edges that can lie on a route of ``longest`` steps to a target: those into a package that reaches one, found backwards."""
    near = stored(targets.select("ecosystem", F.col("target").alias("name")).distinct(), "routes-near")
    front, every = near, near
    for level in range(longest - 1):
        back = steps.join(by_keys(front.withColumnRenamed("name", "child")), ["ecosystem", "child"], "left_semi").select("ecosystem", F.col("parent").alias("name")).distinct()
        front = stored(back.join(by_keys(every), ["ecosystem", "name"], "left_anti"), f"routes-back-{level}")
        if front.isEmpty():
            break
        every = every.unionByName(front)
    return stored(steps.join(by_keys(every.withColumnRenamed("name", "child")), ["ecosystem", "child"], "left_semi"), "routes-steps")


def _first_routes(steps: DataFrame, roots: DataFrame, longest: int) -> DataFrame:
    """``ecosystem, name, route``: of every package within ``longest`` names the shortest route, of equals the first in order.

    A root is its own route; where other roots lead to it too, the first of those routes is a second row.
    One frontier serves all: a level holds each package once.  Its routes, all of
    one length, are numbered in order; what meets a package is the numbers, of
    which tasks keep the least before they shuffle.  A level holds what no
    level but the roots held, so that a route can only come back to its root.
    """
    front = stored(roots.select("ecosystem", "name", F.array("name").alias("route")), "routes-front")
    found, seen = [front], None
    for level in range(longest - 1):
        laid = numbered(front, ["route"], "at")
        met = laid.select("ecosystem", F.col("name").alias("parent"), "at", F.col("route")[0].alias("root")).join(by_keys(steps), ["ecosystem", "parent"])
        least = met.where("child <> root").groupBy("ecosystem", "child").agg(F.min("at").alias("at"))
        if seen is not None:
            least = least.join(by_keys(seen), ["ecosystem", "child"], "left_anti")
        longer = least.join(by_keys(laid.select("at", "route")), "at").select("ecosystem", F.col("child").alias("name"), F.concat("route", F.array("child")).alias("route"))
        front = stored(longer, f"routes-front-{level}")
        if front.isEmpty():
            break
        found.append(front)
        new = front.select("ecosystem", F.col("name").alias("child"))
        seen = new if seen is None else seen.unionByName(new)
    return reduce(DataFrame.unionByName, found)


def _searched_alone(steps: DataFrame, roots: DataFrame, targets: DataFrame, longest: int) -> DataFrame:
    """``ecosystem, target, route``: routes to each target that never pass it before their end, with a frontier of its own for each."""
    spark = steps.sparkSession
    target = ["ecosystem", "target"]
    front = stored(targets.join(roots, "ecosystem").select(*target, F.col("name").alias("parent"), F.array("name").alias("route")), "routes-alone")
    seen = targets.select(*target, F.col("target").alias("child"))
    found = spark.createDataFrame([], "ecosystem string, target string, route array<string>")
    for level in range(longest):
        if front.isEmpty():
            break
        grown = front.join(steps, ["ecosystem", "parent"]).where(~F.array_contains("route", F.col("child")))
        grown = stored(grown.select(*target, "child", F.concat("route", F.array("child")).alias("route")), f"routes-grown-{level}")
        found = found.unionByName(grown.where("child = target").select(*target, "route"))
        fresh = grown.where("child <> target").join(seen, [*target, "child"], "left_anti")
        front = stored(fresh.groupBy(*target, "child").agg(F.min("route").alias("route")), f"routes-alone-{level}")
        seen = seen.unionByName(front.select(*target, "child"))
        front = front.withColumnRenamed("child", "parent")
    return found


def routes_to(edges: DataFrame, roots: DataFrame, targets: DataFrame, limit: int = 3, longest: int = 12) -> DataFrame:
    """The first routes from any root to each target: ``ecosystem, target, turn, route``.

    Routes are in order of length, then of their names; of those that reach a
    target through the same package before it, the first counts.  A target that
    is a root has itself as its only route, and a route is a root and at most
    ``longest`` further names.

    Edges that lead to no target are dropped first, backwards from the targets.
    Then one search from all roots, for all targets together, gives every package
    its first route, so that its tables grow with the packages and not with
    roots or targets; a target's routes are the first routes of its
    parents with itself put behind, by their numbers in the order of all, cut to
    ``limit`` in each task before they are shuffled.  A parent whose own first route passes the target has to be
    reached another way: only targets for which such a parent could still give
    one of the first ``limit`` routes are searched for again, each alone.
    """
    asked = targets.select("ecosystem", F.col("name").alias("target")).distinct()
    roots = stored(roots.select("ecosystem", "name").distinct(), "routes-roots")
    target = ["ecosystem", "target"]
    own = roots.withColumnRenamed("name", "target")
    direct = asked.join(by_keys(own), target, "left_semi")
    open_ = stored(asked.join(by_keys(own), target, "left_anti"), "routes-asked")
    every_step = stored(edges.where("parent IS NOT NULL AND parent <> child").select("ecosystem", "parent", "child").distinct(), "routes-edges")
    steps = _reaching(every_step, open_, longest)
    first = numbered(_first_routes(steps, roots, longest).withColumn("size", F.size("route")), ["size", "route"], "at")
    last = steps.join(by_keys(open_.withColumnRenamed("target", "child")), ["ecosystem", "child"], "left_semi")
    met = first.withColumnRenamed("name", "parent").join(by_keys(last), ["ecosystem", "parent"])
    met = stored(met.select("ecosystem", F.col("child").alias("target"), "at", "size", F.array_contains("route", F.col("child")).alias("passes")), "routes-met")
    order = ("size", "route")
    best = heads(met.where("NOT passes").select(*target, "at"), target, ["at"], limit).join(by_keys(first.select("at", "route")), "at")
    best = best.select(*target, F.concat("route", F.array("target")).alias("route")).withColumn("size", F.size("route"))
    best = stored(best, "routes-best")
    # What a parent beyond the target may offer is longer than its first route with the target behind it.
    offered = met.where("passes").groupBy(*target).agg((F.min("size") + 1).alias("least"))
    reached = best.groupBy(*target).agg(F.count("*").alias("n"), F.max("size").alias("most"))
    again = offered.where(F.col("least") <= longest + 1).join(by_keys(reached), target, "left").where((F.coalesce("n", F.lit(0)) < limit) | (F.col("most") >= F.col("least")))
    again = stored(again.select(*target), "routes-again")
    every = best.select(*target, "route")
    if not again.isEmpty():
        alone = _searched_alone(steps, roots, again, longest)
        every = every.join(again, target, "left_anti").unionByName(alone)
    ranked = heads(every.withColumn("size", F.size("route")), target, order, limit, "turn")
    return ranked.select(*target, "turn", "route").unionByName(direct.select(*target, F.lit(1).alias("turn"), F.array("target").alias("route")))
