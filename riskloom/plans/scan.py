"""Runs: scan, check, diff and history as compositions of operators.

A run returns frames; nothing is computed until a sink or the caller asks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..corpus import DEFAULT, Corpus
from ..operators import changes, correlate, exposure, rules, scoring, suppress
from ..schema import FINDING, complete
from ..sources import feeds, installed, manifests
from ..sources import online as online_sources
from ..sources.settings import Policy
from .storage import stored


@dataclass
class Feeds:
    """Tables that online rules read; those left out say nothing."""

    releases: DataFrame | None = None
    downloads: DataFrame | None = None
    attestations: DataFrame | None = None
    intel_hits: DataFrame | None = None
    intel_records: DataFrame | None = None


@dataclass
class Report:
    packages: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    suppressed: DataFrame
    known: DataFrame | None = None
    campaigns: correlate.Campaigns | None = None
    changes: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)
    online: bool = False
    as_of: datetime | None = None
    edges: DataFrame | None = None


def service_feeds(packages: DataFrame, client: online_sources.Client) -> tuple[Feeds, list[str]]:
    """What the registries and the advisory service say of packages, each answer fetched once, and what could not be asked.

    ``packages`` are complete rows; the answers are stored, so that no later
    step asks again.
    """
    asked = packages.where("kind = 'package' AND name IS NOT NULL").select("ecosystem", "name", F.when(F.col("version") != "", F.col("version")).alias("version")).distinct()
    npm, pypi = (stored(asked.where(F.col("ecosystem") == e), f"asked-{e}") for e in ("npm", "pypi"))
    of_npm = stored(online_sources.npm_releases(npm, client), "npm-releases")
    of_pypi = stored(online_sources.pypi_releases(pypi, client), "pypi-releases")
    hits = stored(online_sources.osv_hits(packages, client), "osv-hits")
    proofs = feeds.slsa_provenance(stored(online_sources.npm_bundles(npm, client), "npm-bundles"))
    proofs = proofs.unionByName(feeds.publisher_provenance(stored(online_sources.pypi_bundles(of_pypi, client), "pypi-bundles")), allowMissingColumns=True)
    found = Feeds(
        releases=of_npm.unionByName(of_pypi.drop("filename"), allowMissingColumns=True),
        downloads=stored(online_sources.npm_downloads(npm, client), "npm-downloads"),
        attestations=proofs,
        intel_hits=hits,
        intel_records=stored(online_sources.osv_records(hits, client), "osv-records"),
    )
    failed = found.releases.where("lookup_status = 'failed'").select("ecosystem", "name").distinct()
    n = failed.count()
    first = failed.orderBy("ecosystem", "name").first() if n else None
    return found, [f"{n} lookups failed, so some online rules saw nothing (first: {first['ecosystem']}:{first['name']})"] if n else []


def enrich(packages: DataFrame, from_feeds: Feeds) -> DataFrame:
    """Packages with what the feeds say of them."""
    out = packages
    if from_feeds.intel_hits is not None:
        records = from_feeds.intel_records
        if records is None:
            records = packages.sparkSession.createDataFrame([], "id string, summary string, aliases array<string>, withdrawn string")
        out = feeds.with_intel(out, feeds.split_intel(from_feeds.intel_hits, records))
    if from_feeds.releases is not None:
        seen = F.col("published_at").isNotNull() | (F.col("lookup_status").eqNullSafe("ok"))
        history = feeds.release_history(from_feeds.releases.where(seen))
        unseen = from_feeds.releases.where(~seen)
        out = feeds.with_registry(out, history.unionByName(unseen, allowMissingColumns=True), from_feeds.downloads)
    if from_feeds.attestations is not None:
        out = feeds.with_provenance(out, from_feeds.attestations)
    return complete(out)


def judge(
    packages: DataFrame,
    as_of: datetime,
    policy: Policy = Policy(),
    online: bool = False,
    source_files: DataFrame | None = None,
    install_sources: DataFrame | None = None,
    accepted: DataFrame | None = None,
    corpus: Corpus = DEFAULT,
) -> Report:
    """All active rules over complete package rows, suppressed, scored."""
    spark = packages.sparkSession
    active = {r.id for r in rules.active_rules(online, policy.disable)}
    found = rules.row_findings(packages, as_of, online, policy.disable, policy.fresh_days, corpus)
    warnings = [f"expired suppression: {i.rule} on {i.package} (expired {i.expires})" for i in policy.expired]
    if "HEM101" in active:
        found = found.unionByName(rules.near_miss_findings(packages, corpus))
    if source_files is not None:
        found = found.unionByName(rules.source_findings(source_files).where(F.col("rule_id").isin(*active)))
    seen = None
    if policy.correlate:
        files = install_sources if install_sources is not None else spark.createDataFrame([], "pkg_id string, rel string, text string")
        seen = correlate.correlate(packages, files)
        found = found.unionByName(correlate.campaign_findings(seen, packages, online).where(F.col("rule_id").isin(*active)))
    found = stored(found, "findings")
    found, suppressed = suppress.apply_ignores(found, packages, policy.ignores)
    known = None
    if accepted is not None:
        found, known = suppress.apply_baseline(found, packages, accepted)
    scored = scoring.verdicts(packages, found, rules.rules_table(spark))
    if seen is not None:
        seen = correlate.live_campaigns(seen, found, packages)
    return Report(packages, found, scored, suppressed, known, seen, warnings=warnings, online=online, as_of=as_of)


def _asked(packages: DataFrame, online: bool, from_feeds: Feeds | None, client: online_sources.Client | None) -> tuple[DataFrame, list[str]]:
    """Packages with what feeds, given or fetched, say of them, and warnings."""
    warnings: list[str] = []
    if online and from_feeds is None and client is not None:
        from_feeds, warnings = service_feeds(packages, client)
    return (enrich(packages, from_feeds) if online and from_feeds is not None else packages), warnings


def scan(
    texts: DataFrame,
    as_of: datetime,
    policy: Policy = Policy(),
    online: bool = False,
    from_feeds: Feeds | None = None,
    installed_rows: DataFrame | None = None,
    root: str | None = None,
    client: online_sources.Client | None = None,
    **inputs,
) -> Report:
    """A run over manifest texts (project, origin, basename, text).

    With ``root``, a folder that the executors share, installed copies are read
    from it: their scripts, their code and what their hooks run.  With a
    ``client``, an online run asks the services.
    """
    packages = complete(manifests.dedupe(manifests.parse_manifests(texts)))
    if installed_rows is not None:
        packages = manifests.attach_installed(packages, installed_rows)
    if root is not None:
        packages = stored(installed.with_installed(packages, root), "installed")
        inputs.setdefault("source_files", stored(installed.source_files(packages), "source-files"))
        inputs.setdefault("install_sources", stored(installed.install_sources(packages), "install-sources"))
    packages, warnings = _asked(packages, online, from_feeds, client)
    packages = stored(complete(packages), "packages")
    report = judge(packages, as_of, policy, online, **inputs)
    nothing_read = source_warning(packages) if policy.correlate and root is not None else None
    report.warnings += warnings + ([nothing_read] if nothing_read else [])
    return report


CHECK_SCOPE = "Only the name was judged: nothing is installed under it here and no lockfile pins it{}."


def check(spark: SparkSession, specs: list[str], as_of: datetime, default: str = "npm", policy: Policy = Policy(), online: bool = False, from_feeds: Feeds | None = None, client: online_sources.Client | None = None) -> Report:
    """A run over names given by hand. A spec without a name raises ``ValueError``."""
    named = spark.createDataFrame([(s,) for s in specs], "text string").select("text", manifests.parse_spec(F.col("text"), default).alias("s"))
    empty = [r["text"] for r in named.where("coalesce(s.name, '') = ''").collect()]
    if empty:
        raise ValueError(f"no package name in {empty[0]!r}")
    packages = complete(named.select("s.*", F.col("s.version").alias("spec"), F.lit(True).alias("direct"), F.lit("(command line)").alias("origin")))
    packages, warnings = _asked(packages, online, from_feeds, client)
    report = judge(packages, as_of, policy, online)
    report.warnings += warnings + [CHECK_SCOPE.format("" if online else "; --online asks the registries too")]
    return report


def diff(base: DataFrame, head: DataFrame, as_of: datetime, policy: Policy = Policy(), online: bool = False, from_feeds: Feeds | None = None, root: str | None = None, client: online_sources.Client | None = None, **inputs) -> Report:
    """A run over what was added or updated between two sets of complete package rows."""
    delta = stored(changes.compare(base, head), "changes")
    touched = delta.where(F.col("change").isin("added", "updated")).select(F.col("head_id").alias("pkg_id"))
    subjects = head.join(touched, "pkg_id", "left_semi")
    if root is not None:
        subjects = stored(installed.with_installed(subjects, root), "installed")
        inputs.setdefault("source_files", stored(installed.source_files(subjects), "source-files"))
        inputs.setdefault("install_sources", stored(installed.install_sources(subjects), "install-sources"))
    subjects, warnings = _asked(subjects, online, from_feeds, client)
    report = judge(stored(subjects, "subjects"), as_of, policy, online, **inputs)
    report.changes = delta
    report.warnings += warnings
    return report


@dataclass
class History:
    commits: DataFrame
    windows: DataFrame
    reported: DataFrame
    summary: DataFrame
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)


def history(commits: DataFrame, snapshots: DataFrame, as_of: datetime, intel: DataFrame | None = None, tags: DataFrame | None = None, package: str = "", truncated: bool = False) -> History:
    """A run over snapshots (idx, ecosystem, name, version) of pinned versions at commits."""
    spark = commits.sparkSession
    if intel is None:
        intel = spark.createDataFrame([], "ecosystem string, name string, version string, malware array<struct<id:string,summary:string,aliases:array<string>>>, advisories array<string>")
    every = exposure.with_intel(exposure.windows(snapshots, commits, F.lit(as_of)), intel)
    every = stored(every, "windows")
    shown = exposure.reported(every, package)
    if tags is not None:
        shown = exposure.tags_during(shown, tags)
    else:
        shown = shown.withColumn("tags", F.array().cast("array<string>"))
    return History(commits, every, shown, exposure.summary(every, shown), truncated)


def pinned_snapshots(texts: DataFrame, commits: DataFrame) -> DataFrame:
    """Manifest texts whose project is a commit, to the versions pinned at each."""
    found = manifests.parse_manifests(texts).where("kind = 'package' AND coalesce(version, '') <> ''")
    return found.join(commits.select("idx", F.col("sha").alias("project")), "project").select("idx", "ecosystem", "name", "version").distinct()


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


SCOPE_WARNING = "No installed packages were found, so payload and endpoint checks had nothing to read."


def source_warning(packages: DataFrame) -> str | None:
    """What to say when correlation had npm packages but no source to read."""
    row = packages.where("ecosystem = 'npm'").agg(F.count("*").alias("n"), F.count_if(F.col("source_dir").isNotNull()).alias("read")).first()
    return SCOPE_WARNING if row["n"] and not row["read"] else None


RULE_IDS = tuple(r.id for r in fixed.RULES)
