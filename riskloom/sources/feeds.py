"""Registry records, attestations and advisories, joined to packages as tables.

A lookup has a status: ``ok``, ``absent`` (the registry has nothing by that
name) or ``failed`` (nobody knows).  Only ``absent`` means unpublished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import pep503
from ..functions.urls import repo_slug


def parse_time(value: Column) -> Column:
    """An ISO time as a timestamp in UTC, null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(value, r"Z$", "+00:00"))


#: Earlier publishers that a record names; the others are counted.
PRIOR_NAMED = 3


def release_history(releases: DataFrame, every: bool = False) -> DataFrame:
    """Each release with what came strictly before it.

    ``releases`` has ``name, version, published_at (string), publisher,
    unpacked_size``; added are ``n_prior_publishers`` (who published anything of
    that name before), ``prior_publishers`` (of them the first few by name; with
    ``every`` all of them),
    ``publisher_new`` (this one is none of them) and ``prior_unpacked_size``.
    Earlier means an earlier time as written; releases at the same time are not
    earlier than each other, and of the last known sizes at one time that of the
    greatest version counts.  To a release without a time all that have one are
    earlier.

    Without ``every`` nothing grows along a history: a publisher counts where it is first seen, and
    the least few names so far are running minima.  What a name displaces on its
    way into the least, or itself if it does not get in, is what the next place
    chooses from.
    """
    stamp = F.dense_rank().over(Window.partitionBy("name").orderBy(F.asc_nulls_last("published_at")))
    ranked = releases.withColumn("stamp", stamp)
    of_publisher = Window.partitionBy("name", "publisher").orderBy("stamp", "version")
    seen = ranked.withColumn("turn", F.row_number().over(of_publisher)).withColumn("since", F.min("stamp").over(of_publisher))
    entering = F.when(F.col("turn") == 1, F.col("publisher"))
    in_order = Window.partitionBy("name").orderBy("stamp", "publisher", "version").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("name").orderBy("stamp").rangeBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("place_0", entering)
    for k in range(1, PRIOR_NAMED):
        held = F.min(f"place_{k - 1}").over(in_order)
        seen = seen.withColumn(f"place_{k}", F.when(F.col(f"place_{k - 1}").isNotNull() & held.isNotNull(), F.greatest(f"place_{k - 1}", held)))
    sized = F.when(F.col("unpacked_size") > 0, F.struct("stamp", "version", "unpacked_size"))
    first_few = F.array_compact(F.array(*[F.min(f"place_{k}").over(before) for k in range(PRIOR_NAMED)]))
    return seen.withColumns(
        {
            "n_prior_publishers": F.count("place_0").over(before),
            "prior_publishers": F.array_sort(F.collect_list("place_0").over(before)) if every else first_few,
            "publisher_new": F.col("since") == F.col("stamp"),
            "prior_unpacked_size": F.max(sized).over(before)["unpacked_size"],
        }
    ).drop("stamp", "turn", "since", *[f"place_{k}" for k in range(PRIOR_NAMED)])


def with_registry(packages: DataFrame, history: DataFrame, downloads: DataFrame | None = None) -> DataFrame:
    """Packages with their release's record: one lookup per distinct release, fanned out again.

    ``history`` is ``release_history`` with ``ecosystem``, ``deprecated``,
    ``yanked``, ``yanked_reason``, ``repository`` and ``lookup_status``.
    """
    # Without a version, the latest release speaks for the name.
    latest = history.groupBy("ecosystem", "name").agg(F.max_by("version", F.struct("published_at", "version")).alias("latest"))
    keys = packages.where("kind = 'package'").select("ecosystem", "name", "version").distinct()
    asked = keys.join(latest, ["ecosystem", "name"], "left").withColumn("resolved_version", F.coalesce("version", "latest")).drop("latest")
    meta = history.select(
        "ecosystem",
        "name",
        F.col("version").alias("resolved_version"),
        F.when(F.col("lookup_status") == "absent", F.lit(True)).alias("unpublished"),
        "publisher",
        "prior_publishers",
        "n_prior_publishers",
        "publisher_new",
        parse_time(F.col("published_at")).alias("published_at"),
        "unpacked_size",
        "prior_unpacked_size",
        "deprecated",
        "yanked",
        "yanked_reason",
        F.when(F.col("lookup_status") == "ok", F.coalesce(F.col("repository"), F.lit("")) == "").alias("repo_missing"),
        repo_slug(F.col("repository")).alias("declared_repo"),
    )
    # The registry lacks a name, not one of its releases: whatever version was asked for.
    gone = history.where("lookup_status = 'absent'").select("ecosystem", "name").distinct().withColumn("gone", F.lit(True))
    found = asked.join(meta, ["ecosystem", "name", "resolved_version"], "left").join(gone, ["ecosystem", "name"], "left")
    found = found.withColumn("unpublished", F.coalesce("gone", "unpublished")).drop("gone")
    if downloads is not None:
        found = found.join(downloads.select("ecosystem", "name", "downloads"), ["ecosystem", "name"], "left")
    own = [c for c in packages.columns if c not in found.columns or c in ("ecosystem", "name", "version")]
    kept = packages.select(*own)
    same = [kept[c].eqNullSafe(found[c]) for c in ("ecosystem", "name", "version")]
    joined = kept.join(found, same, "left").drop(found["ecosystem"], found["name"], found["version"])
    return joined.select(*[c for c in packages.columns if c in joined.columns], *[c for c in joined.columns if c not in packages.columns])


def with_provenance(packages: DataFrame, attestations: DataFrame) -> DataFrame:
    """Packages with the attestation of their release, if there is one."""
    struct = F.struct(*[F.col(c) if c in attestations.columns else F.lit(None).cast("string").alias(c) for c in ("source", "kind", "repository", "workflow", "ref", "commit")])
    one = attestations.groupBy("ecosystem", "name", "version").agg(F.min(struct).alias("provenance"))
    return packages.drop("provenance").join(one, ["ecosystem", "name", "version"], "left")


_STATEMENT = (
    "struct<predicateType:string,predicate:struct<buildDefinition:struct<"
    "externalParameters:struct<workflow:struct<repository:string,path:string,ref:string>>,"
    "resolvedDependencies:array<struct<digest:struct<gitCommit:string>>>>>>"
)


def slsa_provenance(bundles: DataFrame) -> DataFrame:
    """``bundles`` (ecosystem, name, version, at, payload in base64) to the first build statement of each release."""
    statement = F.from_json(F.try_to_binary("payload", F.lit("base64")).cast("string"), _STATEMENT)
    read = bundles.withColumn("s", statement).where(F.col("s.predicateType") == "https://slsa.dev/provenance/v1")
    work = F.col("s.predicate.buildDefinition.externalParameters.workflow")
    path = F.substring_index(work["path"], "/", -1)
    commit = F.try_element_at(F.col("s.predicate.buildDefinition.resolvedDependencies"), F.lit(1))["digest"]["gitCommit"]
    row = F.struct(F.lit("slsa").alias("source"), repo_slug(work["repository"]).alias("repository"), F.when(path != "", path).alias("workflow"), work["ref"].alias("ref"), commit.alias("commit"))
    return read.groupBy("ecosystem", "name", "version").agg(F.min_by(row, "at").alias("p")).select("ecosystem", "name", "version", "p.*")


def publisher_provenance(bundles: DataFrame) -> DataFrame:
    """``bundles`` (ecosystem, name, version, at, publisher as JSON) to the first bundle with a publisher."""
    schema = "struct<kind:string,repository:string,workflow:string,environment:string>"
    read = bundles.withColumn("p", F.from_json("publisher", schema)).where("p.kind IS NOT NULL OR p.repository IS NOT NULL OR p.workflow IS NOT NULL")
    row = F.struct(F.lit("pep740").alias("source"), F.col("p.kind").alias("kind"), repo_slug(F.col("p.repository")).alias("repository"), F.col("p.workflow").alias("workflow"), F.col("p.environment").alias("ref"))
    return read.groupBy("ecosystem", "name", "version").agg(F.min_by(row, "at").alias("p")).select("ecosystem", "name", "version", "p.*")


def advisory_name() -> Column:
    """The name that the advisory feed knows a package by."""
    return F.when(F.col("ecosystem") == "pypi", pep503(F.col("name"))).otherwise(F.col("name"))


def split_intel(hits: DataFrame, records: DataFrame) -> DataFrame:
    """``hits`` (ecosystem, name, version, at, id) to ``malware`` and ``advisories`` of each release, in the feed's order.

    Ids that begin with MAL- report malware unless their record is withdrawn; a missing record withdraws nothing.
    """
    detail = records.select("id", "summary", "aliases", "withdrawn")
    joined = hits.join(detail, "id", "left").withColumn("is_malware", F.col("id").startswith("MAL-"))
    live = joined.where(~F.col("is_malware") | F.col("withdrawn").isNull())
    report = F.struct("at", F.struct("id", F.coalesce("summary", F.lit("Reported as malicious")).alias("summary"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).alias("r"))
    lists = live.groupBy("ecosystem", "name", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_malware"), report))).alias("m"),
        F.sort_array(F.collect_list(F.when(~F.col("is_malware"), F.struct("at", "id")))).alias("a"),
    )
    return lists.select("ecosystem", "name", "version", F.col("m.r").alias("malware"), F.col("a.id").alias("advisories"))


def with_intel(packages: DataFrame, intel: DataFrame) -> DataFrame:
    """Pinned packages with their reports; the feed is joined by its own form of the name."""
    asked = packages.drop("malware", "advisories").withColumn("feed_name", advisory_name())
    known = intel.select("ecosystem", F.col("name").alias("feed_name"), "version", "malware", "advisories")
    return asked.join(known, ["ecosystem", "feed_name", "version"], "left").drop("feed_name").select(*[c for c in packages.columns if c not in ("malware", "advisories")], "malware", "advisories")
