"""Copies that names resolve to, and routes, against plain searches."""

import json
import random
from collections import deque

from riskloom.operators import routes
from riskloom.sources import manifests


def plain_routes(edges, roots, target, limit):
    """A queue of paths: a package is entered once, and the target only as an end."""
    if target in roots:
        return [[target]]
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    found, entered, queue = [], {target}, deque([r] for r in sorted(roots))
    while queue and len(found) < limit:
        path = queue.popleft()
        if len(path) > 12:
            continue
        for child in sorted(below.get(path[-1], ())):
            if child == target:
                found.append([*path, child])
            elif child not in path and child not in entered:
                entered.add(child)
                queue.append([*path, child])
    return found[:limit]


def check(spark, edges, roots, targets, limit):
    e = spark.createDataFrame([("npm", a, b) for a, b in edges], "ecosystem string, parent string, child string")
    r = spark.createDataFrame([("npm", x) for x in roots], "ecosystem string, name string")
    t = spark.createDataFrame([("npm", x) for x in targets], "ecosystem string, name string")
    got = {}
    for row in routes.routes_to(e, r, t, limit=limit).orderBy("target", "turn").collect():
        got.setdefault(row["target"], []).append(row["route"])
    assert got == {x: found for x in targets if (found := plain_routes(edges, set(roots), x, limit))}


def test_random_graphs_with_cycles(spark):
    rnd = random.Random(8)
    for n, m, k in ((8, 20, 3), (14, 30, 3), (10, 45, 2)):
        nodes = [f"n{i:02}" for i in range(n)]
        edges = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(m)})
        check(spark, edges, rnd.sample(nodes, 3), [*nodes, "nowhere"], k)


def test_a_parent_that_is_first_reached_through_the_target(spark):
    # u is reached through t, and by a longer way around it; the longer way is a route to t.
    edges = [("r", "t"), ("t", "u"), ("u", "t"), ("r", "x"), ("x", "y"), ("y", "u")]
    check(spark, edges, ["r"], ["t", "u"], 3)


def test_routes_end_after_twelve_steps(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)]
    check(spark, chain, ["c00"], [f"c{i:02}" for i in range(21)], 1)


def test_no_roots_or_targets(spark):
    check(spark, [("a", "b")], [], ["b"], 3)
    check(spark, [("a", "b")], ["a"], [], 3)


def lock(packages):
    return json.dumps({"packages": packages})


def test_the_nearest_copy_is_resolved(spark):
    packages = {
        "": {"dependencies": {"kit": "1", "shared": "1"}},
        "node_modules/kit": {"version": "1.0.0", "dependencies": {"shared": "*", "ghost": "*"}},
        "node_modules/kit/node_modules/shared": {"version": "3.0.0", "optionalDependencies": {"deep": "*"}},
        "node_modules/kit/node_modules/shared/node_modules/deep": {"version": "9.0.0", "peerDependencies": {"shared": "*", "kit": "*"}},
        "node_modules/shared": {"version": "2.0.0", "dependencies": {"deep": "*"}},
        "node_modules/deep": {"version": "8.0.0"},
        "packages/own": {"name": "@me/own", "dependencies": {"shared": "*"}},
        "packages/own/node_modules/shared": {"version": "4.0.0"},
    }
    texts = spark.createDataFrame([("p", "package-lock.json", "package-lock.json", lock(packages)), ("q", "package-lock.json", "package-lock.json", "{ no json")], manifests.TEXTS)
    found = routes.resolved_edges(manifests.lock_entries(texts)).collect()
    assert {(r["parent_path"], r["child"]): (r["child_path"], r["version"]) for r in found} == {
        ("", "kit"): ("node_modules/kit", "1.0.0"),
        ("", "shared"): ("node_modules/shared", "2.0.0"),
        ("node_modules/kit", "shared"): ("node_modules/kit/node_modules/shared", "3.0.0"),
        ("node_modules/kit/node_modules/shared", "deep"): ("node_modules/kit/node_modules/shared/node_modules/deep", "9.0.0"),
        ("node_modules/kit/node_modules/shared/node_modules/deep", "shared"): ("node_modules/kit/node_modules/shared", "3.0.0"),
        ("node_modules/kit/node_modules/shared/node_modules/deep", "kit"): ("node_modules/kit", "1.0.0"),
        ("node_modules/shared", "deep"): ("node_modules/deep", "8.0.0"),
        ("packages/own", "shared"): ("packages/own/node_modules/shared", "4.0.0"),
    }
    assert {r["parent"] for r in found if r["parent_path"] == "packages/own"} == {"@me/own"}


def test_poetry_edges_from_texts(spark):
    text = '[[package]]\nname = "Flask"\nversion = "3"\n[package.dependencies]\nwerk_zeug = ">=3"\nabsent = "*"\n\n[[package]]\nname = "werk-zeug"\nversion = "3"\n'
    texts = spark.createDataFrame([("p", "poetry.lock", "poetry.lock", text), ("q", "poetry.lock", "poetry.lock", "= broken")], manifests.TEXTS)
    edges = routes.manifest_edges(texts, manifests.lock_entries(texts))
    assert {(r["ecosystem"], r["parent"], r["child"]) for r in edges.collect()} == {("pypi", None, "flask"), ("pypi", "flask", "werk-zeug")}


def test_roots_come_of_names_alone(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c"), ("e", "e")], "parent string, child string")
    found = routes.wanted_by_none(edges.select(edges.parent.alias("name")), edges)
    assert sorted(r["name"] for r in found.collect()) == ["a", "d"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Broadcast" not in plan


def test_routes_are_met_by_their_numbers(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(routes, "stored", lambda df, label, real=routes.stored: written.setdefault(label, df) and real(df, label))
    edges = spark.createDataFrame([("npm", "a", "b"), ("npm", "b", "c"), ("npm", "a", "c")], "ecosystem string, parent string, child string")
    found = routes.routes_to(edges, spark.createDataFrame([("npm", "a")], "ecosystem string, name string"), edges.select("ecosystem", edges.child.alias("name")))
    assert sorted((r["target"], r["turn"], r["route"]) for r in found.collect()) == [("b", 1, ["a", "b"]), ("c", 1, ["a", "c"]), ("c", 2, ["a", "b", "c"])]
    assert "route" not in written["routes-met"].columns


def test_lockfile_entries_are_stored_once_without_what_is_not_asked(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(routes, "stored", lambda df, label, real=routes.stored: written.setdefault(label, df) and real(df, label))
    texts = spark.createDataFrame([("p", "package-lock.json", "package-lock.json", lock({"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1"}}))], manifests.TEXTS)
    found = routes.resolved_edges(manifests.lock_entries(texts))
    assert [(r["child"], r["child_path"]) for r in found.collect()] == [("a", "node_modules/a")]
    assert written["routes-entries"].columns == ["project", "origin", "path", "parent", "version", "names"]
