"""Tables that grow with the packages are dealt by keys, whatever their size on disk says."""

import re

from riskloom.operators import rules, scoring, suppress, views
from riskloom.schema import FINDING, complete
from riskloom.sources import manifests
from riskloom.sources.settings import Ignore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark):
    packages = complete(spark.createDataFrame([("npm", "lodahs", "1.0"), ("npm", "zzqqxxyyzzqq", "2.0")], "ecosystem string, name string, version string"))
    ids = {r["name"]: r["pkg_id"] for r in packages.collect()}
    return packages, spark.createDataFrame([(ids["lodahs"], "HEM403", ["x"])], FINDING), ids


def test_verdicts_send_only_the_rules(spark):
    packages, found, ids = rows_of(spark)
    scored = scoring.verdicts(packages, found, rules.rules_table(spark))
    assert plan(scored.where("severity <> 'clean'").select("name")).count("BroadcastHashJoin") == 1
    assert {r["name"]: r["score"] > 0 for r in scored.collect()} == {"lodahs": True, "zzqqxxyyzzqq": False}


def test_ignores_send_nothing(spark):
    packages, found, ids = rows_of(spark)
    left, gone = suppress.apply_ignores(found, packages, [Ignore("HEM4*", "lod*")])
    assert "Broadcast" not in plan(left) and "Broadcast" not in plan(gone)
    assert left.count() == 0 and gone.count() == 1


def test_near_names_come_back_by_keys(spark):
    packages, _, ids = rows_of(spark)
    found = rules.near_miss_findings(packages, carry=["name"])
    assert [r["name"] for r in found.collect()] == ["lodahs"]
    assert "SortMergeJoin" in plan(found)


def test_first_names_of_crowds_are_taken_before_they_are_dealt(spark):
    names = [("npm", f"p{i}", str(i % 2)) for i in range(9)] + [("npm", f"q{i}", "1") for i in range(4)]
    packages = complete(spark.createDataFrame(names, "ecosystem string, name string, version string"))
    found = packages.selectExpr("pkg_id", "if(name LIKE 'p%', 'HEM403', 'HEM401') AS rule_id", "array('x') AS evidence")
    told = views.crowd_names(scoring.verdicts(packages, found, rules.rules_table(spark)), 3, least=5)
    shown = plan(told)
    assert re.search(r"row_number\(\), 3, Partial", shown)  # each task keeps three names of its share of a crowd
    assert shown.count("BroadcastHashJoin") == 2  # with the rules, of names and of counts
    assert [(r["rules"], r["turn"], r["name"]) for r in told.orderBy("turn").collect()] == [(["HEM403"], n + 1, f"p{n}") for n in range(3)]


def test_installed_copies_are_dealt_by_names(spark, tmp_path):
    rows_of(spark)[0].write.parquet(f"{tmp_path}/packages")
    packages = spark.read.parquet(f"{tmp_path}/packages")  # a few KB, as Spark sees it
    own = "ecosystem string, name string, scripts map<string,string>, repository string, homepage string, source_dir string"
    installed = spark.createDataFrame([("npm", "lodahs", {"install": "x"}, None, None, "/a")], own)
    installed.write.parquet(f"{tmp_path}/installed")
    found = manifests.attach_installed(packages, spark.read.parquet(f"{tmp_path}/installed"))
    assert "Broadcast" not in plan(found)
    assert {r["name"]: r["source_dir"] for r in found.collect()} == {"lodahs": "/a", "zzqqxxyyzzqq": None}
