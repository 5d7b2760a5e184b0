"""Command line: ``python -m riskloom.cli scan PATH`` and its relatives."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fixed
from .operators import exposure, routes, scoring, suppress, views
from .plans import scan as runs
from .plans.storage import forget, shared_folder, stored, written
from .schema import complete
from .sinks import documents
from .sources import feeds, history, manifests, online, settings

POLICY_FILE, BASELINE_FILE = "riskloom.toml", ".riskloom-baseline.json"
WORKFLOW_FILE = os.path.join(".github", "workflows", "riskloom.yml")


def _at_least(least: int):
    def read(text: str) -> int:
        if not text.lstrip("-").isdigit() or int(text) < least:
            raise argparse.ArgumentTypeError(f"{text} is no whole number from {least}")
        return int(text)

    return read


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riskloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "baseline", "history", "init"):
        sub.add_parser(name).add_argument("path", nargs="?", default=".")
    p = sub.add_parser("why")
    p.add_argument("name")
    p.add_argument("path", nargs="?", default=".")
    p = sub.add_parser("check")
    p.add_argument("names", nargs="+")
    p.add_argument("--ecosystem", choices=("npm", "pypi"), default="npm")
    p = sub.add_parser("diff", help="two manifests, or a folder with --since")
    p.add_argument("paths", nargs="*")
    p.add_argument("--since")
    sub.add_parser("rules")
    sub.add_parser("explain").add_argument("rule")
    for p in sub.choices.values():
        p.add_argument("--format", choices=("text", "json", "sarif", "markdown"), default="text")
        p.add_argument("--config")
        p.add_argument("--fail-on", choices=fixed.FAIL_LEVELS)
        p.add_argument("--online", action="store_true", help="ask registries and the advisory service")
        p.add_argument("--fresh-days", type=_at_least(0), help="days that a release counts as fresh")
        p.add_argument("--no-correlate", action="store_true", help="judge every package by itself")
        p.add_argument("--ignore-baseline", action="store_true", help="report accepted findings too")
    sub.choices["history"].add_argument("--package", default="")
    sub.choices["history"].add_argument("--limit", type=_at_least(1), default=200)
    sub.choices["history"].add_argument("--since", default="")
    return top


def _wrong(text: str) -> int:
    print(text, file=sys.stderr)
    return 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: online.Client | None = None) -> int:
    """Exit status: 1 if a verdict is at or above the failing level, 2 on wrong use.

    ``client`` answers for the services of an online run; without one they are
    asked over HTTPS.  Tables that a run has stored are deleted at its end.
    """
    mark = written()
    try:
        return _run(argv, spark, client)
    finally:
        if written() > mark:
            forget(SparkSession.active(), mark)


def _run(argv: list[str] | None, spark: SparkSession | None, client: online.Client | None) -> int:
    args = _parser().parse_args(argv)
    now = datetime.now(timezone.utc)
    root = getattr(args, "path", ".")
    if args.command == "diff":
        if wrong := _diff_refused(args):
            return _wrong(wrong)
        root = (args.paths or ["."])[0] if args.since else "."
    if not os.path.isdir(root):
        return _wrong(f"{root} is no folder")
    try:
        policy = settings.read_policy(args.config or settings.default_path(root, POLICY_FILE), now.date())
    except settings.PolicyError as e:
        return _wrong(str(e))
    policy = replace(policy, fresh_days=policy.fresh_days if args.fresh_days is None else args.fresh_days, correlate=policy.correlate and not args.no_correlate)
    if args.command == "rules":
        for r in fixed.RULES:
            if r.online or not args.online:
                print(f"{r.id}  {r.weight:>3}  {r.category:<10}  {r.title}{'  (online)' if r.online else ''}")
        return 0
    if args.command == "explain":
        return _explain(args.rule)
    if args.command == "init":
        return _init(root)
    spark = spark or SparkSession.builder.appName("riskloom").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    client = (client or online.https_client(_answers_folder(spark))) if args.online else None
    asked = {"online": args.online, "client": client}
    if args.command == "history":
        return _history(args, spark, root, now, client)
    if args.command == "why":
        return _why(args, spark, root, now, policy, asked)
    if args.command == "check":
        try:
            report = runs.check(spark, args.names, now, args.ecosystem, policy, **asked)
        except ValueError as e:
            return _wrong(str(e))
    elif args.command == "diff" and not args.since:
        old, new = (manifests.dedupe(manifests.parse_manifests(manifests.read_files(spark, [p]))) for p in args.paths)
        report = runs.diff(old, new, now, policy, **asked)
    elif args.command == "diff":
        repo = history.top_folder(root)
        base = repo and history.resolve_commit(repo, args.since)
        if not base:
            return _wrong(f"{args.since} is no revision of {root}")
        paths = [os.path.relpath(p, repo) for p in manifests.find_manifests(os.path.realpath(root))]
        old = history.manifest_texts(spark, repo, [base], paths).withColumn("project", F.lit(""))
        new = manifests.read_manifests(spark, root)
        report = runs.diff(manifests.dedupe(manifests.parse_manifests(old)), manifests.dedupe(manifests.parse_manifests(new)), now, policy, root=root, **asked)
    else:
        accepted = settings.read_baseline(os.path.join(root, BASELINE_FILE)) if args.command == "scan" and not args.ignore_baseline else None
        known = spark.createDataFrame([(x,) for x in accepted], "fingerprint string") if accepted else None
        report = _scanned(spark, root, now, policy, accepted=known, **asked)
    if args.command == "baseline":
        prints = [r["fingerprint"] for r in suppress.fingerprints(report.findings, report.packages).select("fingerprint").collect()]
        print(f"{settings.write_baseline(os.path.join(root, BASELINE_FILE), prints, f'{now:%Y-%m-%dT%H:%M:%SZ}')} findings accepted")
        return 0
    fail_on = args.fail_on or policy.fail_on
    if args.format == "text":
        print(documents.report_text(report, fail_on, show_all=args.command == "check"))
    else:
        print({"json": documents.report_json, "sarif": documents.report_sarif, "markdown": documents.report_markdown}[args.format](report))
    return views.gate(report.verdicts, fail_on).first()["exit_code"]


def _diff_refused(args: argparse.Namespace) -> str | None:
    """Why the operands of ``diff`` cannot be compared: it takes two manifests, or a folder and a revision."""
    files = [p for p in args.paths if not os.path.isdir(p)]
    if args.since:
        return "pass two manifests or --since, not both" if files or len(args.paths) > 1 else None
    if len(args.paths) != 2:
        return "diff takes two manifests, or a folder with --since"
    for p in args.paths:
        if not os.path.isfile(p):
            return f"{p} is no file"
        if not manifests.is_manifest(os.path.basename(p)):
            return f"{p} is not a manifest that can be read"
    return None


def _answers_folder(spark: SparkSession) -> str | None:
    """Where answers of services are kept: the user's cache in a local run, else beside the checkpoints if tasks can write there by path."""
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache"), "riskloom")
    shared = shared_folder(spark)
    return os.path.join(shared.removeprefix("file://"), "answers") if shared.startswith(("file://", "/")) else None


def _scanned(spark: SparkSession, root: str, now: datetime, policy: settings.Policy, **options) -> runs.Report:
    """A folder's manifests as a report, with the edges between its packages."""
    texts = manifests.read_manifests(spark, root)
    report = runs.scan(texts, now, policy, root=root, **options)
    report.edges = stored(routes.manifest_edges(texts, manifests.lock_entries(texts)), "edges")
    return report


#: What a category looks at, for ``explain``.
_LOOKS_AT = {
    "naming": "the name itself, beside the names that people type every day; installing the wrong one runs a stranger's code",
    "install": "the scripts that a package manager runs on its own while it installs, before anybody has read a line",
    "code": "the files of the installed copy, for shapes that hide what the code does from a reviewer",
    "lockfile": "how a manifest pins what it asks for: whether another build could get other bytes under the same name",
    "registry": "what the registry tells of a release: who published it, when, how large it is and who uses it",
    "provenance": "signed statements of where and from what source a release was built",
    "intel": "public records that name this exact version",
    "campaign": "what packages of different owners have in common, which one package at a time does not show",
}


def _explain(asked: str) -> int:
    r = fixed.RULE_BY_ID.get(asked.upper())
    if r is None:
        return _wrong(f"no rule {asked}")
    print(f"{r.id}  {r.title}")
    print(f"It belongs to the category {r.category}, which reads {_LOOKS_AT[r.category]}.")
    counted = "it settles the verdict by itself" if r.certain else "the heaviest finding of a category counts in full, others in part, and each further category raises the sum"
    print(f"Its weight is {r.weight} of 100: {counted}.")
    print("It runs with --online alone, as it needs answers of a service." if r.online else "It runs offline.")
    print(f"What to do: {r.fix}")
    return 0


_WORKFLOW = """\
name: dependencies
on:
  pull_request:
  push:
    branches: [main]
  schedule:
    - cron: "17 5 * * 1"
permissions:
  contents: read
jobs:
  judge:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
        with:
          fetch-depth: 0
      - uses: actions/setup-python@v5
        with:
          python-version: "3.12"
      - run: pip install pyspark pyarrow pandas .
      # A request is judged by what it changes, the branch by all it holds.
      - if: github.event_name == 'pull_request'
        run: python -m riskloom.cli diff --since "origin/${{ github.base_ref }}" --format markdown >> "$GITHUB_STEP_SUMMARY"
      - if: github.event_name == 'push'
        run: python -m riskloom.cli scan .
      # What was installed once, against what is known by now.
      - if: github.event_name == 'schedule'
        run: python -m riskloom.cli history . --online --fail-on critical
"""


def _init(root: str) -> int:
    """Write a policy file with the defaults and a CI workflow; what is there stays."""
    texts = {POLICY_FILE: 'fail_on = "high"\nfresh_days = 14\ncorrelate = true\ndisable = []\n', WORKFLOW_FILE: _WORKFLOW}
    for name, text in texts.items():
        path = os.path.join(root, name)
        if os.path.exists(path):
            print(f"{path} is there already")
            continue
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        print(f"wrote {path}")
    return 0


def _why(args: argparse.Namespace, spark: SparkSession, root: str, now: datetime, policy: settings.Policy, asked: dict, most: int = 6) -> int:
    """How a package came in, and what there is to say of it: of the name in any case, else of names that hold it."""
    report = _scanned(spark, root, now, policy, **asked)
    packages = report.verdicts.where("kind = 'package'")
    found = packages.where(F.lower("name") == args.name.lower())
    if found.isEmpty():
        found = packages.where(F.lower("name").contains(args.name.lower()))
    names = [r["name"] for r in found.select("name").distinct().orderBy("name").limit(most + 2).collect()]
    if not names:
        return _wrong(f"no package matching {args.name!r} in {root}")
    rows = scoring.ordered(found.withColumn("how", scoring.arithmetic())).limit(most + 1).collect()
    if len(rows) > most:
        return _wrong(f"{args.name!r} matches more than {most} packages: {', '.join(names)}...")
    targets = found.select("ecosystem", "name").distinct()
    ways: dict[tuple[str, str], list[str]] = {}
    for r in routes.routes_to(report.edges, routes.roots_of(report.edges, report.packages), targets).orderBy("target", "turn").collect():
        ways.setdefault((r["ecosystem"], r["target"]), []).append(" > ".join(r["route"]))
    for r in rows:
        print("\n".join(documents.verdict_lines(r)))
        led = ways.get((r["ecosystem"], r["name"]), [])
        if r["direct"] or led == [r["name"]]:
            print("     asked for directly")
        elif led:
            print("\n".join(f"     via {w}" for w in led))
        else:
            print("     no route: nothing in these manifests brings it in")
        if not r["findings"]:
            print("     nothing flagged")
    return 0


def _history(args: argparse.Namespace, spark: SparkSession, root: str, now: datetime, client: online.Client | None) -> int:
    repo = history.top_folder(root)
    if not repo:
        return _wrong(f"{root} is in no repository")
    since = history.resolve_commit(repo, args.since) if args.since else ""
    if since is None:
        return _wrong(f"{args.since} is no revision of {root}")
    paths = [os.path.relpath(p, repo) for p in manifests.find_manifests(os.path.realpath(root))]
    if not paths:
        print("no manifest with a history here")
        return 0
    commits, more = history.commits_touching(spark, repo, paths, args.limit, since)
    shas = [r["sha"] for r in commits.orderBy("idx").collect()]
    shots = runs.pinned_snapshots(history.manifest_texts(spark, repo, shas, paths), commits)
    intel = None
    if client is not None:
        pinned = complete(shots.select("ecosystem", "name", "version").distinct())
        hits = stored(online.osv_hits(pinned, client), "history-hits")
        intel = feeds.split_intel(hits, online.osv_records(hits, client))
    found = runs.history(commits, shots, now, intel, package=args.package, truncated=more)
    if client is not None:
        ends = found.reported.select("entered_sha", "left_sha").collect()  # reported windows alone
        tags = history.tags_containing(spark, repo, [s for r in ends for s in r if s])
        found.reported = exposure.tags_during(found.reported.drop("tags"), tags)
    if history.is_shallow(repo):
        found.warnings.append("this is a shallow clone, so older commits are missing")
    print(documents.history_json(found) if args.format == "json" else documents.history_text(found, args.package, args.online))
    if not args.fail_on or args.fail_on == "never":
        return 0
    floor = fixed.SEVERITY_ORDER.index(args.fail_on)
    return int(not found.reported.where(scoring.severity_rank(F.col("severity")) >= floor).isEmpty())


if __name__ == "__main__":
    sys.exit(main())
