"""The rules: what each finds in a package row, as columns.

``row_evidence`` holds one array-of-strings column per rule that needs the row
alone, so that one scan evaluates all that are active and inactive ones are
never planned.  Rules that need another table (names, source files, links) are
frames of ``(pkg_id, rule_id, evidence)``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from datetime import datetime

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..corpus import DEFAULT, Corpus
from ..functions import names, texts, urls
from ..plans.storage import by_keys

_NONE = "array<string>"
ON_JOINS = ("HEM101", "HEM301", "HEM302", "HEM801", "HEM802", "HEM803")


def _one(condition: Column, text: Column) -> Column:
    """One piece of evidence where the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(F.array().cast(_NONE))


def _many(*texts_: Column) -> Column:
    return F.array_compact(F.array(*texts_))


def hooks() -> Column:
    """The install-time scripts of a package, in their order."""
    return F.map_entries(F.map_filter(F.coalesce("scripts", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*fixed.HOOKS)))


def _hook_matches(pattern: str) -> Column:
    hit = F.filter(hooks(), lambda h: h["value"].rlike(f"(?iU){pattern}"))
    return F.transform(hit, lambda h: F.concat(h["key"], F.lit(": "), texts.clip(h["value"])))


def _credentials() -> Column:
    marks = F.array(*[F.lit(m) for m in sorted(fixed.CREDENTIAL_MARKS)])

    def found(h: Column) -> Column:
        return F.filter(marks, lambda m: F.lower(h["value"]).contains(F.lower(m)))

    touched = F.filter(hooks(), lambda h: F.size(found(h)) > 0)
    return F.transform(touched, lambda h: F.concat(h["key"], F.lit(" references "), F.array_join(F.slice(found(h), 1, 4), ", ")))


def _install_hook() -> Column:
    shown = F.array_join(F.transform(hooks(), lambda h: F.concat(h["key"], F.lit(": "), texts.clip(h["value"]))), ", ")
    flagged = _one(F.col("has_install_script"), F.lit("lockfile records an install script (node_modules not present to read it)"))
    return F.when(F.size(hooks()) > 0, F.array(shown)).otherwise(flagged)


def _affix() -> Column:
    """What ``_with_affixes`` has joined to a row."""
    text = F.concat(F.lit('"'), F.col("_worn.stripped"), F.lit('" with "'), F.col("_worn.affix"), F.lit('" attached'))
    return _one(F.col("_worn").isNotNull(), text)


def _with_affixes(packages: DataFrame, corpus: Corpus) -> DataFrame:
    """Rows with ``_worn``: the popular name and the affix that a name consists of, if it is not popular itself."""
    known = names.with_affixes(packages.sparkSession, corpus, fixed.AFFIXES)
    popular = names.popular_table(packages.sparkSession, corpus)
    known = known.join(popular.withColumnRenamed("target", "worn"), ["ecosystem", "worn"], "left_anti")
    known = known.select(F.col("ecosystem").alias("_eco"), "worn", F.struct("stripped", "affix").alias("_worn"))
    name = names.compared_name(F.col("ecosystem"), F.col("name"))
    return packages.join(F.broadcast(known), (F.col("ecosystem") == F.col("_eco")) & (name == F.col("worn")), "left").drop("_eco", "worn")


def _look_alikes() -> Column:
    labels = []
    for c, plain in fixed.LOOK_ALIKES.items():
        labels += [F.lit(c), F.lit(f'"{c}" ({unicodedata.name(c, f"U+{ord(c):04X}")}) reads as "{plain}"')]
    known = F.create_map(*labels)

    def shown(c: Column) -> Column:
        code = F.concat(F.lit("non-ASCII character U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))
        return F.coalesce(F.try_element_at(known, c), F.when(F.ascii(c) > 127, code))

    return F.array_compact(F.transform(F.split("name", ""), shown))


def _scope_drop(corpus: Corpus) -> Column:
    scoped = [F.lit(n) for n in corpus.npm if n.startswith("@")]

    def at(sep: str) -> Column:
        name = F.col("name")
        head = F.substring_index(name, sep, 1)
        scope = F.concat(F.lit("@"), head, F.lit("/"), F.substr(name, F.length(head) + 2))
        hit = name.contains(sep) & (head.isin(*fixed.SCOPE_HEADS) | (scope.isin(scoped) if scoped else F.lit(False)))
        return F.when(hit, F.concat(F.lit('resembles the scoped package "'), scope, F.lit('"')))

    first = F.coalesce(*[at(s) for s in ("-", "_", ".")])
    return _one((F.col("ecosystem") == "npm") & ~F.col("name").startswith("@") & first.isNotNull(), first)


def _floating() -> Column:
    spec = F.trim(F.coalesce("spec", F.lit("")))
    loose = spec.isin("*", "latest", "x") | spec.rlike(r"^[\^~>*]")
    unpinned = F.coalesce("version", F.lit("")) == ""
    return _one((spec != "") & unpinned & loose, F.concat(F.lit('"'), F.col("name"), F.lit('" requested as "'), spec, F.lit('"')))


def _no_hash() -> Column:
    from ..schema import coord

    locked = F.col("origin").endswith(fixed.HASHED_LOCKFILES[0])
    for name in fixed.HASHED_LOCKFILES[1:]:
        locked = locked | F.col("origin").endswith(name)
    pinned = (F.coalesce("version", F.lit("")) != "") & (F.coalesce("integrity", F.lit("")) == "") & ~F.coalesce("link", F.lit(False))
    return _one(pinned & locked, F.concat(coord(), F.lit(" pinned without a hash")))


def _outside() -> Column:
    return urls.outside_source(F.col("resolved"), F.col("spec"), F.col("vcs"))


def _fresh(as_of: datetime, fresh_days: int) -> Column:
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("published_at")) / 1e6
    hours = F.floor(age / 3600)
    when = F.when(hours < 48, F.concat(hours.cast("string"), F.lit(" hours ago"))).otherwise(F.concat(F.floor(age / 86400).cast("string"), F.lit(" days ago")))
    which = F.coalesce(F.when(F.col("version") != "", F.col("version")), F.col("resolved_version"))
    return _one(age < fresh_days * 86400, F.concat(F.coalesce(F.concat(which, F.lit(" ")), F.lit("")), F.lit("published "), when))


def new_publisher() -> Column:
    """Whether a release's publisher had published nothing of the package while others had; of a record without counts, by its list."""
    prior = F.coalesce("prior_publishers", F.array().cast(_NONE))
    fresh = F.coalesce("publisher_new", ~F.array_contains(prior, F.col("publisher")))
    return (F.coalesce("publisher", F.lit("")) != "") & (F.coalesce("n_prior_publishers", F.size(prior)) > 0) & fresh


def _publisher_changed() -> Column:
    prior = F.coalesce("prior_publishers", F.array().cast(_NONE))
    others = F.coalesce("n_prior_publishers", F.size(prior)) - 3
    named = F.concat(F.array_join(F.slice(prior, 1, 3), ", "), F.when(others > 0, F.concat(F.lit(" and "), others.cast("string"), F.lit(" others"))).otherwise(""))
    return _one(new_publisher(), F.concat(F.lit('published by "'), F.col("publisher"), F.lit('", who had not published this package before; earlier releases by '), named))


def _withdrawn() -> Column:
    deprecated = F.when(F.coalesce("deprecated", F.lit("")) != "", F.concat(F.lit("deprecated: "), texts.clip(F.col("deprecated"))))
    reason = F.when(F.coalesce("yanked_reason", F.lit("")) != "", F.col("yanked_reason")).otherwise("no reason given")
    return _many(deprecated, F.when(F.col("yanked"), F.concat(F.lit("yanked: "), texts.clip(reason))))


def _size_jump() -> Column:
    now, before = F.col("unpacked_size"), F.col("prior_unpacked_size")
    return _one((now > before * 3) & (before > 20_000), F.concat(texts.human_size(before), F.lit(" -> "), texts.human_size(now), F.lit(" since the previous release")))


def _unpublished() -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False))
    own = flag("workspace") | flag("link") | flag("vcs") | (_outside() != "")
    return _one(flag("unpublished") & ~own, F.concat(F.when(F.col("ecosystem") == "npm", "npm").otherwise("PyPI"), F.lit(" has no package under this name")))


def _built_from() -> Column:
    p = F.col("provenance")
    commit = F.when(F.coalesce(p["commit"], F.lit("")) != "", F.concat(F.lit("@"), F.left(p["commit"], F.lit(7)))).otherwise("")
    workflow = F.when(F.coalesce(p["workflow"], F.lit("")) != "", F.concat(F.lit(" via "), p["workflow"])).otherwise("")
    return F.concat(F.coalesce(p["repository"], F.lit("an unnamed repository")), commit, workflow)


def _malware() -> Column:
    def shown(r: Column) -> Column:
        some = F.size(F.coalesce(r["aliases"], F.array().cast(_NONE))) > 0
        aliases = F.when(some, F.concat(F.lit(" ("), F.array_join(F.slice(r["aliases"], 1, 2), ", "), F.lit(")"))).otherwise("")
        return F.concat(r["id"], aliases, F.lit(": "), texts.clip(r["summary"], 70))

    return F.coalesce(F.transform("malware", shown), F.array().cast(_NONE))


def _advisories() -> Column:
    n = F.size(F.coalesce("advisories", F.array().cast(_NONE)))
    text = F.concat(n.cast("string"), F.lit(" advisor"), F.when(n == 1, "y").otherwise("ies"), F.lit(": "), texts.joined_some(F.col("advisories"), 4))
    return _one(n > 0, text)


def row_evidence(as_of: datetime, fresh_days: int = 14, corpus: Corpus = DEFAULT) -> dict[str, Callable[[], Column]]:
    """Of each rule that needs a package row alone, its evidence column."""
    outside = lambda: texts.clip(_outside(), 100)
    extra = F.coalesce("extra_indexes", F.array().cast(_NONE))
    since = F.to_timestamp(F.lit(fixed.PROVENANCE_SINCE))
    signed = F.col("provenance").isNotNull()
    built, declared = F.col("provenance")["repository"], F.col("declared_repo")
    return {
        "HEM102": _affix,
        "HEM103": _look_alikes,
        "HEM104": lambda: _scope_drop(corpus),
        "HEM201": _install_hook,
        "HEM202": lambda: _hook_matches(fixed.FETCH_AND_RUN),
        "HEM203": lambda: _hook_matches(fixed.DECODE_AND_EXECUTE),
        "HEM204": _credentials,
        "HEM401": _floating,
        "HEM402": _no_hash,
        "HEM403": lambda: _one(F.col("resolved").startswith("http://"), F.col("resolved")),
        "HEM404": lambda: _one(_outside() != "", outside()),
        "HEM405": lambda: F.transform(F.filter(extra, lambda u: ~u.contains("pypi.org")), lambda u: F.concat(F.lit("resolves against "), u, F.lit(" as well as PyPI"))),
        "HEM501": lambda: _fresh(as_of, fresh_days),
        "HEM502": _publisher_changed,
        "HEM503": _withdrawn,
        "HEM504": lambda: _one(F.col("downloads") < 500, F.concat(F.col("downloads").cast("string"), F.lit(" downloads in the last week"))),
        "HEM505": lambda: _one(F.col("repo_missing"), F.lit("no repository URL in registry metadata")),
        "HEM506": _size_jump,
        "HEM507": _unpublished,
        "HEM601": lambda: _one(~signed & (F.col("published_at") >= since), F.concat(F.lit("published "), F.date_format("published_at", "yyyy-MM-dd"), F.lit(" with no attestation on the registry"))),
        "HEM602": lambda: _one(built != declared, F.concat(F.lit("declared "), declared, F.lit(", but built from "), _built_from())),
        "HEM701": _malware,
        "HEM702": _advisories,
    }


def active_rules(online: bool = False, disabled: Iterable[str] = ()) -> list[fixed.RuleInfo]:
    """The rules to plan, by id."""
    off = set(disabled)
    return sorted((r for r in [*fixed.RULES, *_USER_INFO] if (online or not r.online) and r.id not in off), key=lambda r: r.id)


_USER_INFO: list[fixed.RuleInfo] = []
_USER_EVIDENCE: dict[str, Callable[[], Column]] = {}


def rule(id: str, category: str, weight: int, title: str, online: bool = False, certain: bool = False, fix: str = ""):
    """Register a rule of one's own: a function without arguments that returns an array-of-strings column over a package row."""

    def register(evidence: Callable[[], Column]) -> Callable[[], Column]:
        if id in fixed.RULE_BY_ID or id in _USER_EVIDENCE:
            raise ValueError(f"rule {id} exists already")
        if category not in fixed.CATEGORIES:
            raise ValueError(f"no category {category}")
        _USER_INFO.append(fixed.RuleInfo(id, category, weight, title, online, certain, fix))
        _USER_EVIDENCE[id] = evidence
        return evidence

    return register


def forget_rule(id: str) -> None:
    """Take a registered rule back."""
    _USER_EVIDENCE.pop(id)
    _USER_INFO[:] = [r for r in _USER_INFO if r.id != id]


def rules_table(spark, rules: Iterable[fixed.RuleInfo] | None = None) -> DataFrame:
    """The rule dimension: ``rule_id, category, weight, title, online, certain, fix``."""
    columns = {"rule_id": "id", "category": "category", "weight": "weight", "title": "title", "online": "online", "certain": "certain", "fix": "fix"}
    kinds = {"weight": pa.int32(), "online": pa.bool_(), "certain": pa.bool_()}
    known = list(rules or [*fixed.RULES, *_USER_INFO])
    return spark.createDataFrame(pa.table({c: pa.array([getattr(r, name) for r in known], kinds.get(c, pa.string())) for c, name in columns.items()}))


_BUILT: dict[tuple, Column] = {}


def _built(r: fixed.RuleInfo, evidence: Callable[[], Column], asked: tuple) -> Column:
    """A rule's id and evidence as a struct.

    It depends on the rule and on what is asked alone, and takes dozens of calls
    to the JVM to build; so it is kept for as long as the session's context.
    """
    key = (SparkContext._active_spark_context, r.id, evidence if r.id in _USER_EVIDENCE else None, asked)
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] is not key[0]]:
            del _BUILT[old]
        seen = evidence()
        if r.category != "lockfile":
            seen = F.when(F.col("kind") == "package", seen).otherwise(F.array().cast(_NONE))
        _BUILT[key] = F.struct(F.lit(r.id).alias("rule_id"), F.filter(seen, lambda e: e != "").alias("evidence"))
    return _BUILT[key]


def row_findings(packages: DataFrame, as_of: datetime, online: bool = False, disabled: Iterable[str] = (), fresh_days: int = 14, corpus: Corpus = DEFAULT, carry: Iterable[str] = ()) -> DataFrame:
    """``(pkg_id, rule_id, evidence)`` of the rules over single rows, by one scan of complete package rows.

    Columns of ``packages`` named in ``carry`` come along.

    Rows that stand for a manifest see the lockfile rules only.
    """
    known = {**row_evidence(as_of, fresh_days, corpus), **_USER_EVIDENCE}
    found = [_built(r, known[r.id], (as_of, fresh_days, corpus)) for r in active_rules(online, disabled) if r.id in known]
    if any(r.id == "HEM102" for r in active_rules(online, disabled)):
        packages = _with_affixes(packages, corpus)
    if not found:
        return packages.select("pkg_id", *carry, F.lit("").alias("rule_id"), F.array().cast(_NONE).alias("evidence")).where("false")
    hits = F.filter(F.array(*found), lambda f: F.size(f["evidence"]) > 0)
    return packages.select("pkg_id", *carry, F.explode(hits).alias("f")).select("pkg_id", *carry, "f.rule_id", "f.evidence")


def near_miss_findings(packages: DataFrame, corpus: Corpus = DEFAULT, carry: Iterable[str] = ()) -> DataFrame:
    """HEM101: names one or two edits from a popular one. Each distinct name is compared once; columns named in ``carry`` come along."""
    rows = packages.where("kind = 'package'").select("pkg_id", *carry, "ecosystem", names.compared_name(F.col("ecosystem"), F.col("name")).alias("compared"))
    popular = names.popular_table(packages.sparkSession, corpus).withColumnRenamed("target", "compared")
    asked = rows.select("ecosystem", "compared").where(F.length("compared") >= 4).join(F.broadcast(popular), ["ecosystem", "compared"], "left_anti")
    near = names.nearest_popular(asked, corpus)
    text = F.concat(texts.plural(F.col("distance"), "edit"), F.lit(' away from "'), F.col("target"), F.lit('"'))
    return rows.join(by_keys(near), ["ecosystem", "compared"]).select("pkg_id", *carry, F.lit("HEM101").alias("rule_id"), F.array(text).alias("evidence"))


def _first_files(source_files: DataFrame) -> DataFrame:
    """The files of a package that are read: code, not too large, the first forty by path."""
    from pyspark.sql.window import Window

    parts = F.split("rel", "/")
    skipped = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*fixed.SOURCE_SKIPPED))
    code = F.lit(False)
    for suffix in fixed.SOURCE_SUFFIXES:
        code = code | F.col("rel").endswith(suffix)
    order = Window.partitionBy("pkg_id").orderBy("rel")
    read = source_files.where(code & ~F.coalesce(skipped, F.lit(False)) & (F.octet_length("text") <= fixed.SOURCE_BYTES_MOST))
    return read.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= fixed.SOURCE_FILES_MOST)


def obfuscation(rel: Column, text: Column) -> Column:
    """Why a file looks unreadable on purpose, or null: escapes, one long line, or a blob of high entropy."""
    escapes = F.regexp_count(text, F.lit(r"\\[xu]"))
    lines = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]")
    longest = F.aggregate(lines, F.lit(0), lambda m, x: F.greatest(m, F.length(x)))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    blobs = F.filter(F.regexp_extract_all(text, F.lit(fixed.LONG_BLOB), F.lit(0)), lambda b: texts.entropy_of_short(b) > 4.5)
    blob = F.try_element_at(blobs, F.lit(1))
    parts = F.split(rel, "/")
    bundled = F.exists(parts, lambda p: p.isin(*fixed.BUNDLE_FOLDERS)) | rel.endswith(".min.js") | rel.endswith(".min.ts")
    return F.when(bundled, None).when(
        (escapes > 200) & (escapes * 4 > F.length(text) * 0.15), F.concat(rel, F.lit(": "), escapes.cast("string"), F.lit(" hex escapes"))
    ).when(
        (longest > 5000) & (newlines < 20), F.concat(rel, F.lit(": single line of "), longest.cast("string"), F.lit(" characters"))
    ).when(
        blob.isNotNull(), F.concat(rel, F.lit(": "), F.length(blob).cast("string"), F.lit("-char blob, entropy "), F.format_string("%.1f", texts.entropy_of_short(blob)))
    )


def source_findings(source_files: DataFrame) -> DataFrame:
    """HEM301 and HEM302 over ``source_files`` (pkg_id, rel, text); evidence by path."""
    files = _first_files(source_files)
    sites = F.regexp_count("text", F.lit(f"(?i){fixed.DYNAMIC_CODE}"))
    dynamic = F.when(sites >= 2, F.concat(F.col("rel"), F.lit(": "), sites.cast("string"), F.lit(" dynamic-execution sites")))
    seen = files.select("pkg_id", "rel", F.explode(F.array(F.struct(F.lit("HEM301").alias("rule_id"), obfuscation(F.col("rel"), F.col("text")).alias("e")), F.struct(F.lit("HEM302").alias("rule_id"), dynamic.alias("e")))).alias("f"))
    seen = seen.where("f.e IS NOT NULL").groupBy("pkg_id", "f.rule_id").agg(F.sort_array(F.collect_list(F.struct("rel", "f.e"))).alias("all"))
    return seen.select("pkg_id", "rule_id", F.col("all.e").alias("evidence"))
