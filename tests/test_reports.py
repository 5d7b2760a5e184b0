"""What reports and the command line tell, and how much of it reaches the driver."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom import cli, fixed
from riskloom.operators import rules, scoring, views
from riskloom.plans import scan, storage
from riskloom.schema import complete
from riskloom.sinks import documents

AS_OF = datetime(2026, 2, 1)


def report_of(spark, *found, malware=()):
    """A report over (name, rules) of npm packages."""
    names = [(n, "1.0.0") for n, _ in found]
    packages = complete(spark.createDataFrame(names, "name string, version string").select(F.lit("npm").alias("ecosystem"), "name", "version", F.lit("package-lock.json").alias("origin")))
    rows = spark.createDataFrame([(n, r, [f"seen in {n} | `x`"]) for n, rs in found for r in rs], "name string, rule_id string, evidence array<string>")
    findings = rows.join(packages.select("pkg_id", "name"), "name").select("pkg_id", "rule_id", "evidence")
    return scan.Report(packages, findings, scoring.verdicts(packages, findings, rules.rules_table(spark)), findings.where("false"))


def crowd(n, *rule_ids):
    return [(f"pkg{i:03}", rule_ids) for i in range(n)]


def test_a_crowd_is_one_block_with_its_first_names(spark):
    text = documents.report_text(report_of(spark, *crowd(30, "HEM401")), "high")
    assert text.count(fixed.RULE_BY_ID["HEM401"].title) == 1 and "30 packages" in text
    assert "pkg023" in text and "pkg024" not in text and "and 6 more" in text and "exit 1" not in text


def test_a_crowd_that_fails_the_run_names_all(spark):
    text = documents.report_text(report_of(spark, *crowd(33, "HEM101")), "medium")
    assert all(f"pkg{i:03}" in text for i in range(33)) and "exit 1: 33 packages at medium or above: pkg000, pkg001, pkg002, pkg003, and 29 more" in text


def test_small_groups_and_malware_stay_single(spark):
    small = fixed.CROWD_LEAST - 1
    assert documents.report_text(report_of(spark, *crowd(small, "HEM401")), "high").count("HEM401") == small
    text = documents.report_text(report_of(spark, *crowd(8, "HEM701"), ("other", ["HEM401", "HEM402"])), "never")
    assert text.count("npm:pkg00") == 8 and "npm:other@1.0.0" in text and "exit 1" not in text


def test_a_large_report_reads_few_rows(spark):
    """Two hundred thousand verdicts alike, and as many by themselves: what is collected does not grow with them."""
    n = 200_000
    base = spark.range(n).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.lit("1").alias("version"))
    packages = complete(base)
    packages = packages.withColumn("rule_id", F.lit("HEM401"))
    findings = packages.select("pkg_id", "rule_id", F.array(F.lit("e")).alias("evidence"))
    verdicts = scoring.verdicts(packages.drop("rule_id"), findings, rules.rules_table(spark)).cache()
    report = scan.Report(packages.drop("rule_id"), findings, verdicts, findings.where("false"))
    assert len(documents.report_text(report, "high").splitlines()) < 10
    single = verdicts.withColumn("certain", F.lit(True))
    report.verdicts = single
    text = documents.report_text(report, "never", most=50)
    assert text.count("npm:p") == 50 and f"and {n - 50:,} more verdicts" in text
    verdicts.unpersist()


def test_markdown_links_marks_and_caution(spark):
    text = documents.report_markdown(report_of(spark, ("@s/chalk", ["HEM701"]), ("colorz", ["HEM101"])))
    assert "> [!CAUTION]" in text and "`@s/chalk@1.0.0`" in text
    assert "[`colorz@1.0.0`](https://www.npmjs.com/package/colorz/v/1.0.0)" in text
    assert "seen in colorz \\| 'x'" in text
    quiet = documents.report_markdown(report_of(spark, ("colorz", [])))
    assert "> [!NOTE]" in quiet and "Nothing flagged" in quiet
    many = documents.report_markdown(report_of(spark, *crowd(25, "HEM101")))
    assert many.count("| 🟡 |") == 20 and "5 more, worst first" in many
    assert documents.registry_page("pypi", "flask", "3.0") == "https://pypi.org/project/flask/3.0/" and documents.registry_page("cargo", "x", None) is None


def test_crowd_heads_and_singles(spark):
    report = report_of(spark, *crowd(7, "HEM401"), ("alone", ["HEM402"]), ("clean", []))
    assert [r["name"] for r in views.crowd_names(report.verdicts, 3).orderBy("turn").collect()] == ["pkg000", "pkg001", "pkg002"]
    assert [r["name"] for r in views.told_singly(report.verdicts).collect()] == ["alone"]


@pytest.fixture
def nested(tmp_path):
    packages = {
        "": {"dependencies": {"app-kit": "^1"}},
        "node_modules/app-kit": {"version": "1.0.0", "integrity": "x", "dependencies": {"build-tools": "*"}},
        "node_modules/build-tools": {"version": "2.0.0", "integrity": "x", "dependencies": {"lodahs": "*"}},
        "node_modules/lodahs": {"version": "1.0.0", "integrity": "x"},
    }
    (tmp_path / "package-lock.json").write_text(json.dumps({"packages": packages}))
    return str(tmp_path)


def test_why(spark, nested, capsys):
    assert cli.main(["why", "LODAHS", nested], spark) == 0
    out = capsys.readouterr().out
    assert "via app-kit > build-tools > lodahs" in out and "HEM101" in out and "fix:" in out
    assert cli.main(["why", "app-kit", nested], spark) == 0
    out = capsys.readouterr().out
    assert "asked for directly" in out and "nothing flagged" in out
    assert cli.main(["why", "nonexistent", nested], spark) == 2
    assert "no package matching" in capsys.readouterr().err


def test_the_scan_view_tells_the_way(spark, nested, capsys):
    cli.main(["scan", nested], spark)
    assert "via app-kit > build-tools > lodahs" in capsys.readouterr().out


def test_check_lists_clean_names(spark, capsys):
    assert cli.main(["check", "lodash", "well-known-thing"], spark) == 0
    out = capsys.readouterr().out
    assert "npm:lodash" in out and "npm:well-known-thing" in out and out.count("clean") == 2


def test_diff_of_two_manifests(spark, tmp_path, capsys):
    old, new = tmp_path / "package-lock.json", tmp_path / "new" / "package-lock.json"
    new.parent.mkdir()
    old.write_text(json.dumps({"packages": {"": {}, "node_modules/express": {"version": "4.0.0", "integrity": "x"}}}))
    new.write_text(json.dumps({"packages": {"": {}, "node_modules/lodahs": {"version": "1.0.0", "integrity": "x"}}}))
    cli.main(["diff", str(old), str(new), "--format", "json"], spark)
    doc = json.loads(capsys.readouterr().out)
    assert doc["results"][0]["name"] == "lodahs" and doc["results"][0]["change"] == "added" and doc["removed"] == [{"ecosystem": "npm", "name": "express"}]
    refused = {
        ("a.json", "--since", "HEAD"): "not both",
        ("only-one.json",): "two manifests",
        (): "two manifests",
        (str(tmp_path / "gone.json"), str(new)): "is no file",
    }
    for args, said in refused.items():
        assert cli.main(["diff", *args], spark) == 2
        assert said in capsys.readouterr().err
    (tmp_path / "a.md").write_text("x")
    assert cli.main(["diff", str(tmp_path / "a.md"), str(new)], spark) == 2
    assert "not a manifest" in capsys.readouterr().err


def test_answers_are_kept_in_a_users_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path))
    assert cli._answers_folder(spark) == str(tmp_path / "riskloom")


def test_a_run_deletes_what_it_stored(spark, nested):
    folder = storage.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    cli.main(["scan", nested], spark)
    assert set(os.listdir(folder)) <= before
    mark = storage.written()
    kept, gone = storage.stored(spark.range(3), "kept-one"), storage.stored(spark.range(3), "gone-one")
    assert storage.forget(spark, mark, keep=("kept-",)) == 1 and kept.count() == 3 and gone is not None
    assert storage.forget(spark, mark) == 1
