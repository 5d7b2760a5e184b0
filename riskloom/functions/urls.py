"""Repositories, owners and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def repo_slug(value: Column) -> Column:
    """``owner/name`` in lower case of any spelling of a repository; null if it has not two parts."""
    text = F.regexp_replace(F.trim(value), r"^(git\+|git:)", "")
    text = F.regexp_replace(text, r"^(github|gitlab|bitbucket):", "")
    of_url = F.regexp_extract(text, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    of_scp = F.when(text.contains(":"), F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)
    scp = text.startswith("git@") | F.substring_index(text, "/", 1).contains("@")
    path = F.when(text.contains("://"), of_url).when(scp, of_scp).otherwise(text)
    path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.git$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.lower(F.array_join(F.slice(parts, -2, 2), "/")))


def owner(ecosystem: Column, name: Column, repository: Column) -> Column:
    """``scope:@x`` of a scoped name, else ``repo:host/owner`` of the repository, else null."""
    text = F.regexp_replace(repository, r"^(git\+|git:|ssh://|git@)", "")
    text = F.regexp_replace(text, r"^([^:]*):", "$1/")  # the first colon only
    parts = F.filter(F.split(F.regexp_replace(text, r"^https?//|^https?://", ""), "/"), lambda p: p != "")
    of_repo = F.concat(F.lit("repo:"), F.lower(F.try_element_at(parts, F.lit(1))), F.lit("/"), F.lower(F.try_element_at(parts, F.lit(2))))
    scoped = (ecosystem == "npm") & name.startswith("@") & name.contains("/")
    return F.when(scoped, F.concat(F.lit("scope:"), F.substring_index(name, "/", 1))).when(F.coalesce(repository, F.lit("")) != "", of_repo)


def _matched_hosts(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?i){fixed.URL_HOST}"), F.lit(1))
    return F.transform(found, lambda h: F.lower(F.substring_index(h, ":", 1)))


def own_hosts(repository: Column, homepage: Column) -> Column:
    """Hosts that a package names as its own."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(_matched_hosts(repository), none), F.coalesce(_matched_hosts(homepage), none))


def unexplained_hosts(text: Column, own: Column) -> Column:
    """Distinct hosts of the URLs in a text, without common hosts, those below them and the package's own."""
    hosts = F.transform(_matched_hosts(text), lambda h: F.regexp_replace(h, r"\.+$", ""))
    common = F.array(*[F.lit(h) for h in fixed.COMMON_HOSTS])
    below = lambda h: F.exists(common, lambda c: h.endswith(F.concat(F.lit("."), c)))
    kept = F.filter(F.array_distinct(hosts), lambda h: (h != "") & ~F.array_contains(common, h) & ~F.array_contains(own, h) & ~below(h))
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_registry_url(source: Column) -> Column:
    """Whether a source is a registry's own URL, with no user in it."""
    authority = F.regexp_extract(source, r"(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    return F.coalesce((authority != "") & ~authority.contains("@") & host.isin(*fixed.REGISTRY_HOSTS), F.lit(False))


def outside_source(resolved: Column, spec: Column, vcs: Column) -> Column:
    """The source of a package that no registry serves; empty if one does."""
    present = lambda c: F.when(c != "", c)
    source = F.coalesce(present(resolved), present(spec), F.lit(""))
    outside = F.coalesce(vcs, F.lit(False)) | source.rlike(fixed.OUTSIDE_REGISTRY)
    return F.when(is_registry_url(source), "").when(outside, source).otherwise("")
