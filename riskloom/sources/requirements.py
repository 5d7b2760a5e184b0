"""Requirements files and dependency specifiers, read by Spark alone.

A file's physical lines are an array; those that say nothing are filtered out, and
what is left is joined again and cut where a line does not end in a backslash.  All
of it happens in the file's own row.  A specifier is two groups of one pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

#: What ends a line of a text file.
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Options that name other files, which are manifests of their own.
_OTHER_FILES = r"^(-r|-c|--requirement|--constraint)"
_EDITABLE = r"^(?:-e|--editable)"


def specifier(text: Column) -> Column:
    """``struct(name, spec, version)`` of a dependency specifier; the name is empty if it begins with none."""
    spec = F.replace(F.regexp_extract(text, fixed.REQUIREMENT, 2), F.lit(" "), F.lit(""))
    pinned = F.when(spec.startswith("=="), F.substr(spec, F.lit(3)))
    return F.struct(F.regexp_extract(text, fixed.REQUIREMENT, 1).alias("name"), F.when(spec != "", spec).alias("spec"), pinned.alias("version"))


def _unquoted(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def name_in_url(url: Column) -> Column:
    """The package that a repository or archive URL is for: what it says itself, else the last part of its path."""
    path = F.rtrim(F.regexp_extract(url, r"^[^:/?#]*:?(?://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    last = F.substring_index(path, "/", -1)
    repository = F.regexp_extract(last, r"^(.*?)\.git(?:@.*)?$", 1)
    word = F.regexp_extract(last, r"^[^@.\-]+", 0)
    named = F.regexp_extract(url, r"#egg=([^&]*)", 1)
    return F.when(url.contains("#egg="), _unquoted(named)).when(repository != "", _unquoted(repository)).when(word != "", word).otherwise(last)


def logical_lines(text: Column) -> Column:
    """An array of a file's lines without comments and blanks, continued lines as one."""
    said = F.transform(F.split(text, _LINE_END), lambda raw: F.regexp_replace(F.substring_index(raw, " #", 1), r"(?U)\s+$", ""))
    told = F.filter(said, lambda line: ~line.rlike(r"(?U)^\s*(#|$)"))
    whole = F.split(F.regexp_replace(F.array_join(told, "\n"), r"\\+(\n|$)", ""), "\n")
    return F.filter(F.transform(whole, lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), lambda line: line != "")


def requirement_packages(texts: DataFrame) -> DataFrame:
    """Package rows of requirements files, and one for a file that names indexes.

    Options that name neither an index nor a folder say nothing of a package.
    """
    files = texts.where(F.col("basename").startswith("requirements")).select("project", "origin", "basename", logical_lines(F.col("text")).alias("lines"))
    lines = files.select("project", "origin", F.posexplode("lines").alias("place", "line"))
    line = F.col("line")
    index = F.regexp_extract(line, fixed.INDEX_OPTION, 1)
    kind = (
        F.when(index != "", "index").when(line.rlike(_OTHER_FILES), "other").when(line.rlike(_EDITABLE), "editable")
        .when(line.rlike(fixed.CODE_URL), "url").otherwise("specifier")
    )
    found = specifier(F.trim(F.substring_index(F.substring_index(line, ";", 1), "--hash", 1)))
    rows = lines.withColumns({"what": kind, "index": index, "s": found})
    by_name = F.col("what") == "specifier"
    packages = rows.where(F.col("what").isin("editable", "url") | (by_name & (F.col("s.name") != ""))).select(
        "project",
        "origin",
        "place",
        F.lit("pypi").alias("ecosystem"),
        F.lit("package").alias("kind"),
        F.when(by_name, F.col("s.name")).when(F.col("what") == "url", name_in_url(line)).otherwise(F.regexp_replace(line, r"(?U)^\S+\s+", "")).alias("name"),
        F.when(by_name, F.col("s.version")).alias("version"),
        F.when(by_name, F.col("s.spec")).when(F.col("what") == "url", line).otherwise("editable").alias("spec"),
        F.when(F.col("what") == "url", line).alias("resolved"),
        F.when(by_name & line.contains("--hash"), "sha256").alias("integrity"),
        F.lit(True).alias("direct"),
        (~by_name).alias("vcs"),
    )
    indexes = F.filter(F.transform("lines", lambda x: F.regexp_extract(x, fixed.INDEX_OPTION, 1)), lambda url: url != "")
    named = files.select(
        "project", "origin", F.size("lines").alias("place"), F.lit("pypi").alias("ecosystem"), F.lit("manifest").alias("kind"), F.col("basename").alias("name"), indexes.alias("extra_indexes")
    ).where(F.size("extra_indexes") > 0)
    return packages.unionByName(named, allowMissingColumns=True)
