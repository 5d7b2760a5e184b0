"""Registry and advisory services as tables of answers.

``answers`` asks a service for every distinct URL of a frame, from the
executors, with one client per partition; everything that follows reads the
answers' JSON with Spark.  A client is any function from (url, body) to
``(status, text)``, where status is ``ok``, ``absent`` (404) or ``failed``;
``https_client`` makes one for the real services.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import pep503

Client = Callable[[str, str | None], tuple[str, str | None]]

#: Addresses of the services, seconds that an answer is kept, bytes of the longest answer, queries of a batch.
NPM, NPM_DOWNLOADS, PYPI = "https://registry.npmjs.org/", "https://api.npmjs.org/downloads/point/last-week/", "https://pypi.org/pypi/"
NPM_ATTESTATIONS, PYPI_ATTESTATIONS = "https://registry.npmjs.org/-/npm/v1/attestations/", "https://pypi.org/integrity/"
OSV_BATCH, OSV_RECORD = "https://api.osv.dev/v1/querybatch", "https://api.osv.dev/v1/vulns/"
KEPT_SECONDS, LONGEST, BATCH = 6 * 3600, 32 * 1024 * 1024, 500


def https_client(cache: str | None = None, timeout: float = 20.0) -> Client:
    """A client over HTTPS without credentials; answers are kept in ``cache``, a folder that all executors may write, if given."""

    def kept(url: str, body: str | None) -> str | None:
        return cache and os.path.join(cache, hashlib.sha256(f"{url}\n{body or ''}".encode()).hexdigest())

    def ask(url: str, body: str | None) -> tuple[str, str | None]:
        parts = urllib.parse.urlsplit(url)
        if parts.scheme != "https" or parts.username or parts.password:
            return "failed", None
        path = kept(url, body)
        if path and os.path.isfile(path) and time.time() - os.path.getmtime(path) < KEPT_SECONDS:
            with open(path, encoding="utf-8") as f:
                status, _, text = f.read().partition("\n")
            return status, text or None
        request = urllib.request.Request(url, body.encode() if body else None, {"Accept": "application/json", "Accept-Encoding": "gzip", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                raw = answer.read(LONGEST + 1)
                if len(raw) > LONGEST:
                    return "failed", None
                if answer.headers.get("Content-Encoding") == "gzip":
                    with gzip.GzipFile(fileobj=io.BytesIO(raw)) as unpacked:
                        raw = unpacked.read(LONGEST + 1)
                found = ("failed", None) if len(raw) > LONGEST else ("ok", raw.decode("utf-8"))
        except urllib.error.HTTPError as e:
            found = ("absent" if e.code == 404 else "failed", None)
        except (OSError, ValueError):
            return "failed", None
        if path and found[0] != "failed":
            os.makedirs(cache, exist_ok=True)
            handle, part = tempfile.mkstemp(dir=cache)
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(f"{found[0]}\n{found[1] or ''}")
            os.replace(part, path)
        return found

    return ask


def answers(asked: DataFrame, client: Client, partitions: int = 12) -> DataFrame:
    """``asked`` (url, body) to distinct ``(url, body, lookup_status, text)``."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [client(u, b if isinstance(b, str) else None) for u, b in zip(part["url"], part["body"])]
            yield part.assign(lookup_status=[s for s, _ in found], text=[t for _, t in found])

    distinct = asked.select("url", F.col("body").cast("string").alias("body")).distinct().repartition(partitions, "url")
    return distinct.mapInPandas(each, "url string, body string, lookup_status string, text string")


def _url(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), *parts)


def quoted(name) -> Column:
    """A package name as a part of a URL; the scope's sign stays."""
    return F.replace(F.url_encode(name), F.lit("%40"), F.lit("@"))


_PERSON, _REPO = "struct<name:string>", "string"
_PACKUMENT = f"struct<`dist-tags`:map<string,string>,time:map<string,string>,repository:{_REPO},versions:map<string,struct<_npmUser:{_PERSON},dist:struct<unpackedSize:bigint>,deprecated:string,repository:{_REPO}>>>"


def _repository(text) -> Column:
    """A repository given as a text or as an object with a url."""
    return F.coalesce(F.get_json_object(text, "$.url"), text)


def npm_releases(names: DataFrame, client: Client) -> DataFrame:
    """Every release of npm packages, in the columns of ``feeds.with_registry``; names that the registry does not have get one row of status absent."""
    asked = names.select("name").distinct().withColumn("url", _url(NPM, quoted(F.col("name"))))
    said = asked.join(answers(asked.withColumn("body", F.lit(None)), client), "url").withColumn("d", F.from_json("text", _PACKUMENT))
    one = said.where("lookup_status = 'ok'").select("name", "d.time", F.col("d.repository").alias("own"), F.explode_outer("d.versions").alias("version", "v"))
    found = one.select(
        F.lit("npm").alias("ecosystem"), "name", "version", F.try_element_at("time", F.col("version")).alias("published_at"), F.col("v._npmUser.name").alias("publisher"),
        F.col("v.dist.unpackedSize").alias("unpacked_size"), F.col("v.deprecated").alias("deprecated"), F.lit(None).cast("boolean").alias("yanked"), F.lit(None).cast("string").alias("yanked_reason"),
        _repository(F.coalesce("v.repository", "own")).alias("repository"), F.lit("ok").alias("lookup_status"),
    )
    missing = said.where("lookup_status <> 'ok'").select(F.lit("npm").alias("ecosystem"), "name", "lookup_status")
    return found.unionByName(missing, allowMissingColumns=True)


def npm_downloads(names: DataFrame, client: Client) -> DataFrame:
    """``ecosystem, name, downloads`` of the last week."""
    asked = names.select("name").distinct().withColumn("url", _url(NPM_DOWNLOADS, quoted(F.col("name"))))
    said = asked.join(answers(asked.withColumn("body", F.lit(None)), client), "url")
    return said.select(F.lit("npm").alias("ecosystem"), "name", F.get_json_object("text", "$.downloads").try_cast("bigint").alias("downloads")).where("downloads IS NOT NULL")


_PROJECT = (
    "struct<info:struct<version:string,yanked:boolean,yanked_reason:string,home_page:string,project_urls:map<string,string>>,"
    "urls:array<struct<filename:string,packagetype:string,size:bigint,upload_time_iso_8601:string>>>"
)
_CODE_LINKS = ("source", "repository", "homepage", "source code", "code", "github")


def pypi_releases(releases: DataFrame, client: Client) -> DataFrame:
    """The asked releases (name, version; a null version means the latest) of PyPI projects, with the file that attestations are for.

    A missing release of a project that exists is a failed lookup; only a missing project is absent.
    """
    slug = F.url_encode(pep503(F.col("name")))
    asked = releases.select("name", "version").distinct()
    of_release = _url(PYPI, slug, F.when(F.col("version").isNotNull(), F.concat(F.lit("/"), F.url_encode("version"))).otherwise(""), F.lit("/json"))
    said = asked.withColumn("url", of_release)
    said = said.join(answers(said.withColumn("body", F.lit(None)), client), "url").drop("url", "body")
    doubtful = said.where("lookup_status = 'absent' AND version IS NOT NULL").select("name").distinct().withColumn("url", _url(PYPI, slug, F.lit("/json")))
    projects = doubtful.join(answers(doubtful.withColumn("body", F.lit(None)), client), "url").select("name", (F.col("lookup_status") != "absent").alias("exists"))
    said = said.join(projects, "name", "left").withColumn("lookup_status", F.when(F.col("exists") & F.col("version").isNotNull() & (F.col("lookup_status") == "absent"), "failed").otherwise(F.col("lookup_status"))).withColumn("d", F.from_json("text", _PROJECT))
    links = F.map_filter(F.coalesce("d.info.project_urls", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*_CODE_LINKS))
    files = F.coalesce("d.urls", F.expr("from_json('[]', 'array<struct<filename:string,packagetype:string,size:bigint,upload_time_iso_8601:string>>')"))
    wheel = F.coalesce(F.try_element_at(F.filter(files, lambda f: f["packagetype"] == "bdist_wheel"), F.lit(1)), F.try_element_at(files, F.lit(1)))
    home = F.when(F.col("d.info.home_page") != "", F.col("d.info.home_page"))
    return said.select(
        F.lit("pypi").alias("ecosystem"), "name", F.coalesce("version", "d.info.version").alias("version"),
        F.array_min(F.transform(files, lambda f: f["upload_time_iso_8601"])).alias("published_at"), F.lit(None).cast("string").alias("publisher"),
        F.array_max(F.transform(files, lambda f: f["size"])).alias("unpacked_size"), F.lit(None).cast("string").alias("deprecated"),
        F.col("d.info.yanked").alias("yanked"), F.col("d.info.yanked_reason").alias("yanked_reason"),
        F.coalesce(home, F.try_element_at(F.map_values(links), F.lit(1))).alias("repository"), "lookup_status", wheel["filename"].alias("filename"),
    )


def npm_bundles(releases: DataFrame, client: Client) -> DataFrame:
    """``ecosystem, name, version, at, payload`` for ``feeds.slsa_provenance``."""
    asked = releases.select("name", "version").where("version IS NOT NULL").distinct()
    asked = asked.withColumn("url", _url(NPM_ATTESTATIONS, quoted(F.concat("name", F.lit("@"), "version"))))
    said = asked.join(answers(asked.withColumn("body", F.lit(None)), client), "url")
    list_ = F.from_json("text", "struct<attestations:array<struct<bundle:struct<dsseEnvelope:struct<payload:string>>>>>")["attestations"]
    return said.select(F.lit("npm").alias("ecosystem"), "name", "version", F.posexplode(list_).alias("at", "b")).select("ecosystem", "name", "version", "at", F.col("b.bundle.dsseEnvelope.payload").alias("payload"))


def pypi_bundles(files: DataFrame, client: Client) -> DataFrame:
    """``ecosystem, name, version, at, publisher`` (as JSON) of files (name, version, filename) for ``feeds.publisher_provenance``."""
    asked = files.select("name", "version", "filename").where("filename IS NOT NULL AND version IS NOT NULL").distinct()
    asked = asked.withColumn("url", _url(PYPI_ATTESTATIONS, F.url_encode(pep503(F.col("name"))), F.lit("/"), F.url_encode("version"), F.lit("/"), F.url_encode("filename"), F.lit("/provenance")))
    said = asked.join(answers(asked.withColumn("body", F.lit(None)), client), "url")
    list_ = F.from_json("text", "struct<attestation_bundles:array<struct<publisher:string>>>")["attestation_bundles"]
    return said.select(F.lit("pypi").alias("ecosystem"), "name", "version", F.posexplode(list_).alias("at", "b")).select("ecosystem", "name", "version", "at", F.col("b.publisher").alias("publisher"))


def osv_hits(packages: DataFrame, client: Client, batch: int = BATCH) -> DataFrame:
    """``ecosystem, name, version, at, id`` of pinned releases, asked in batches; answers of another length than their batch count as failed."""
    from .feeds import advisory_name

    keys = packages.where("kind = 'package' AND coalesce(version, '') <> ''").select("ecosystem", advisory_name().alias("name"), "version").distinct()

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems = {"npm": "npm", "pypi": "PyPI"}
        for part in parts:
            for start in range(0, len(part), batch):
                some = part.iloc[start : start + batch]
                queries = [{"package": {"ecosystem": systems[r.ecosystem], "name": r.name_}, "version": r.version} for r in some.rename(columns={"name": "name_"}).itertuples()]
                status, text = client(OSV_BATCH, json.dumps({"queries": queries}))
                try:
                    results = json.loads(text or "")["results"] if status == "ok" else []
                except (ValueError, KeyError, TypeError):
                    results = []
                rows = []
                if isinstance(results, list) and len(results) == len(some):
                    for key, result in zip(some.itertuples(index=False), results):
                        listed = (result or {}).get("vulns") or [] if isinstance(result, dict) else []
                        rows += [(*key, i, v["id"]) for i, v in enumerate(listed) if isinstance(v, dict) and isinstance(v.get("id"), str)]
                yield pd.DataFrame(rows, columns=["ecosystem", "name", "version", "at", "id"])

    return keys.mapInPandas(each, "ecosystem string, name string, version string, at long, id string")


def osv_records(hits: DataFrame, client: Client) -> DataFrame:
    """``id, summary, aliases, withdrawn`` of the reports of malware among ``hits``."""
    asked = hits.where("id LIKE 'MAL-%'").select("id").distinct().withColumn("url", _url(OSV_RECORD, F.col("id")))
    said = asked.join(answers(asked.withColumn("body", F.lit(None)), client), "url")
    return said.select("id", F.from_json("text", "struct<summary:string,aliases:array<string>,withdrawn:string>").alias("d")).select("id", "d.*")
