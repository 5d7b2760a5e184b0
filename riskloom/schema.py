"""The package row and the tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One dependency as a manifest resolves it, with what registries and feeds say of it.
PACKAGE = {
    "ecosystem": "string",
    "name": "string",
    "kind": "string",
    "version": "string",
    "spec": "string",
    "resolved": "string",
    "integrity": "string",
    "direct": "boolean",
    "dev": "boolean",
    "origin": "string",
    "scripts": "map<string,string>",
    "source_dir": "string",
    "has_install_script": "boolean",
    "link": "boolean",
    "workspace": "boolean",
    "vcs": "boolean",
    "repository": "string",
    "homepage": "string",
    "extra_indexes": "array<string>",
    "unpublished": "boolean",
    "resolved_version": "string",
    "publisher": "string",
    "prior_publishers": "array<string>",
    "n_prior_publishers": "bigint",
    "publisher_new": "boolean",
    "published_at": "timestamp",
    "unpacked_size": "bigint",
    "prior_unpacked_size": "bigint",
    "downloads": "bigint",
    "deprecated": "string",
    "yanked": "boolean",
    "yanked_reason": "string",
    "repo_missing": "boolean",
    "declared_repo": "string",
    "provenance": "struct<source:string,kind:string,repository:string,workflow:string,ref:string,commit:string>",
    "malware": "array<struct<id:string,summary:string,aliases:array<string>>>",
    "advisories": "array<string>",
}

FINDING = "pkg_id string, rule_id string, evidence array<string>"


def coord(name: str = "name", version: str = "version"):
    """``name@version``, or the name where there is no version."""
    return F.concat(F.col(name), F.when(F.coalesce(F.col(version), F.lit("")) != "", F.concat(F.lit("@"), F.col(version))).otherwise(""))


def package_key():
    """``ecosystem:name@version``: the identity of a release, whatever manifest holds it."""
    return F.concat(F.col("ecosystem"), F.lit(":"), coord())


def package_id():
    """Identity of a row: ecosystem, name, version and manifest; nulls have a mark of their own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in ("ecosystem", "name", "version", "origin")]), 256)


def complete(df: DataFrame) -> DataFrame:
    """``df`` with every column of ``PACKAGE``, null where missing, and ``pkg_id`` and ``pkg_key``."""
    have = set(df.columns)
    columns = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in PACKAGE.items()]
    rows = df.select(*columns, *[c for c in df.columns if c not in PACKAGE and c not in ("pkg_id", "pkg_key")])
    rows = rows.withColumns({"kind": F.coalesce("kind", F.lit("package")), "direct": F.coalesce("direct", F.lit(False)), "dev": F.coalesce("dev", F.lit(False)), "origin": F.coalesce("origin", F.lit(""))})
    return rows.withColumns({"pkg_id": package_id(), "pkg_key": package_key()})
