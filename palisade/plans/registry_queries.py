"""Registered queries on manifests, private registries, recorded answers and their cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import dependencies as dp
from palisade.plans.inputs import frame, sql
from palisade.plans.registered import query
from palisade.plans.report import egress_summary

_MANIFESTS = r"""mf AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'm' || p_partkey || '/package.json' WHEN 1 THEN 'm' || p_partkey || '/package-lock.json' WHEN 2 THEN 'm' || p_partkey || '/requirements.txt' WHEN 3 THEN 'm' || p_partkey || '/pyproject.toml' WHEN 4 THEN 'm' || p_partkey || '/poetry.lock' WHEN 5 THEN 'vendor/m' || p_partkey || '/package.json' ELSE 'm' || p_partkey || '/package.json' END AS path,
 CASE p_partkey % 7 WHEN 0 THEN '{"dependencies": {"a' || p_partkey || '": "1.' || p_partkey || '", "@s/b": {"version": "2"}}, "scripts": {"x": "y"}}' WHEN 1 THEN '{"packages": {"": {"version": "0"}, "node_modules/l' || p_partkey || '": {"version": "3.' || p_partkey || '"}, "node_modules/l/node_modules/k": {"version": "1"}}}'
 WHEN 2 THEN 'r' || p_partkey || '[extra]>=1 # note' || chr(10) || '-r other.txt' || chr(10) || 'git+https://x/y' || chr(10) || ' q == 2 ' WHEN 3 THEN '[project]' || chr(10) || 'dependencies = ["p' || p_partkey || '~=4"]' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || 'python = "3"' || chr(10) || 'z = "*"'
 WHEN 4 THEN '[[package]]' || chr(10) || 'name = "k' || p_partkey || '"' || chr(10) || 'version = "5.' || p_partkey || '"' WHEN 5 THEN '{"dependencies": {"no": "1"}}' ELSE '{"dependencies": ' END AS content FROM part)"""


def _manifests(spark, sf_dir):
    inner = _MANIFESTS[_MANIFESTS.index("(SELECT ") + 8 : _MANIFESTS.rindex(" FROM part)")].removeprefix("p_partkey, ")
    path, _, content = inner.partition(" AS path,")
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{path} AS path", content.strip())


_PARSED = """ps AS (SELECT path, v.s AS section, v.n AS name, v.r AS version_req, v.e AS ecosystem, v.c AS "check" FROM mf, LATERAL (
 SELECT 'dependencies' AS s, 'a' || p_partkey AS n, '1.' || p_partkey AS r, 'npm' AS e, true AS c, 0 AS k UNION ALL SELECT 'dependencies', '@s/b', '2', 'npm', true, 0 UNION ALL SELECT 'lockfile packages', 'l' || p_partkey, '3.' || p_partkey, 'npm', true, 1 UNION ALL SELECT 'requirements.txt', 'r' || p_partkey, '[extra]>=1', 'pypi', true, 2
 UNION ALL SELECT 'requirements.txt', 'q', '== 2', 'pypi', true, 2 UNION ALL SELECT 'project.dependencies', 'p' || p_partkey, '~=4', 'pypi', true, 3 UNION ALL SELECT 'tool.poetry.dependencies', 'z', '*', 'pypi', true, 3 UNION ALL SELECT 'lock', 'k' || p_partkey, '5.' || p_partkey, 'pypi', false, 4) v WHERE v.k = p_partkey % 7)"""


@query(f'WITH {_MANIFESTS}, {_PARSED} SELECT path, section, name, version_req, ecosystem, "check", NULL AS error FROM ps UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, \'JSONDecodeError\' FROM mf WHERE p_partkey % 7 = 6')
def manifest_dependencies(spark, sf_dir):
    """Dependencies that manifests of six kinds declare; skipped folders; a manifest that cannot be parsed."""
    return dp.dependencies(_manifests(spark, sf_dir)).select("path", "section", "name", "version_req", "ecosystem", "check", "error")


@query(f"""WITH {sql("deps")}, d AS (SELECT DISTINCT * FROM deps), bad AS (SELECT DISTINCT path, name FROM d WHERE CASE ecosystem WHEN 'npm' THEN NOT (strlen(name) <= 214 AND regexp_matches(name, '^(@[a-z0-9._-]+/)?[a-z0-9._-]+$') AND NOT regexp_matches(name, '^[._]')) OR trim(version_req) = '' ELSE NOT regexp_matches(trim(name), '^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?$') END)
SELECT path, section, name, version_req FROM d ANTI JOIN bad USING (path, name)""")
def eligible_dependencies(spark, sf_dir):
    """Dependencies each once, without those that are rejected before any lookup."""
    deps = frame(spark, sf_dir, "deps")
    return dp.eligible(dp.listed(deps.withColumn("error", F.lit(None).cast("string"))), dp.structural(deps)).select("path", "section", "name", "version_req")


_CONFIGS = [
    (".npmrc", "registry=https://registry.npmjs.org/\n", "package.json", "{}", ""), (".npmrc", "  registry=https://own.example/\n", "a.txt", "x", "npm"), ("w/.npmrc", "registry=https://own.example", "w/package.json", "{}", "npm"),
    ("w/.npmrc", "registry=https://own.example", "v/package.json", "{}", ""), ("pip.conf", "[global]\nindex-url = https://own.example\n", "b", "x", "pypi"), ("x/pip.conf", "index-url = x", "b", "x", ""),
    ("r/requirements.txt", "a==1\n --extra-index-url https://own.example", "b", "x", "pypi"), ("pyproject.toml", "[[tool.poetry.source]]\nname = 'own'\n", "b", "x", "pypi"), ("pyproject.toml", "[tool.uv]\nindex = []\n", "b", "x", "pypi"), ("pyproject.toml", "[tool.poetry]\nsource = []\n", "b", "x", ""),
]


@query(f"SELECT n_nationkey, want FROM nation JOIN (VALUES {', '.join(f'''({i}, '{c[4]}')''' for i, c in enumerate(_CONFIGS))}) AS v(i, want) ON n_nationkey = i")
def private_ecosystems(spark, sf_dir):
    """Which settings say that packages come from a registry of one's own."""
    out = None
    for i, (p, c, q, d, _) in enumerate(_CONFIGS):
        found = dp.private_registries(spark.createDataFrame([(p, c), (q, d)], "path string, content string"), {"PIP_INDEX_URL": "https://pypi.org/simple/"})
        row = found.agg(F.coalesce(F.max("ecosystem"), F.lit("")).alias("want")).select(F.lit(i).cast("long").alias("n_nationkey"), "want")
        out = row if out is None else out.unionByName(row)
    return out


_NOW = 1_000_000
_ANSWERS = """an AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'pkg-' || (p_partkey % 90) AS norm_name, CAST(CASE p_partkey % 90 % 9 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN 204 ELSE 200 END AS INT) AS status FROM part)"""
_CACHED = """ca AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'pkg-' || (p_partkey % 90) AS norm_name, CAST(1000000 - 86400 + (p_partkey % 90 % 5 - 2) * 40000 + CASE WHEN p_partkey % 90 % 5 = 2 THEN 0 ELSE 1 END AS BIGINT) AS fetched_at, p_partkey % 90 % 2 = 0 AS ex FROM part WHERE p_partkey % 90 % 4 = 0)"""
_JOINED = f"""{_ANSWERS}, {_CACHED}, dr AS (SELECT DISTINCT ecosystem, norm_name, status FROM an), dc AS (SELECT DISTINCT ecosystem, norm_name, ex FROM ca WHERE greatest({_NOW} - fetched_at, 0) <= 86400),
j AS (SELECT dr.ecosystem, dr.norm_name, coalesce(ex, CASE WHEN status BETWEEN 200 AND 299 THEN true WHEN status = 404 THEN false END) AS ex, CASE WHEN ex IS NULL THEN CASE WHEN status IS NULL THEN 'unavailable' WHEN status = 429 THEN 'rate_limited' WHEN status = 503 THEN 'invalid_response' END END AS error, CASE WHEN ex IS NULL THEN status END AS status, ex IS NULL AS request_made FROM dr LEFT JOIN dc USING (ecosystem, norm_name))"""


def _parts(spark, sf_dir, text: str, *names: str):
    inner = text[text.index("(SELECT ") + 8 : text.index(" FROM part")]
    out = []
    for n in names:
        e, _, inner = inner.partition(f" AS {n}")
        out.append(f"{e.lstrip(', ')} AS {n}")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return (rows.where("p_partkey % 90 % 4 = 0") if "WHERE p_partkey" in text else rows).selectExpr(*out)


def _resolved(spark, sf_dir):
    answers = dp.resolutions_of(_parts(spark, sf_dir, _ANSWERS, "ecosystem", "norm_name", "status").distinct())
    cache = _parts(spark, sf_dir, _CACHED, "ecosystem", "norm_name", "fetched_at", "ex")
    cache = cache.select(dp.cache_key(F.col("ecosystem"), F.col("norm_name")).alias("key"), "fetched_at", F.col("ex").alias("exists"))
    return dp.with_cache(answers, cache, _NOW)


@query(f"""WITH {_JOINED} SELECT ecosystem, norm_name, ex AS "exists", error, status, request_made, sha256(CASE ecosystem WHEN 'npm' THEN 'Npm' ELSE 'PyPi' END || chr(0) || norm_name) AS key FROM j""")
def registry_answers(spark, sf_dir):
    """Recorded answers of registries, behind a cache whose rows count for a day."""
    rows = _resolved(spark, sf_dir)
    return rows.withColumn("key", dp.cache_key(F.col("ecosystem"), F.col("norm_name")))


_CHECKED = f"""{sql("deps")}, {sql("advisories")}, {_JOINED}, g AS (SELECT DISTINCT ecosystem, name, version_req, is_scoped FROM deps),
n AS (SELECT *, CASE ecosystem WHEN 'npm' THEN name ELSE lower(regexp_replace(name, '[-_.]+', '-', 'g')) END AS norm_name, CASE WHEN regexp_matches(version_req, '^[0-9][A-Za-z0-9.+-]*$') THEN version_req END AS version, contains(lower(name || '@' || version_req), 'sk_live_') AS sens, trim(version_req) <> '' AND NOT contains(version_req, '://') AS plain FROM g),
a AS (SELECT DISTINCT ecosystem, norm_name, version, true AS listed FROM advisories), l AS (SELECT n.*, coalesce(listed, false) AND NOT sens AND plain AS listed FROM n LEFT JOIN a USING (ecosystem, norm_name, version)), b AS (SELECT DISTINCT ecosystem, norm_name, true AS bad FROM l WHERE listed),
v AS (SELECT l.ecosystem, l.name, l.norm_name, version_req, error, status, coalesce(request_made, true) AS request_made, CASE WHEN sens THEN 'sensitive_suppressed' WHEN NOT plain THEN 'non_registry_suppressed' WHEN listed THEN 'known_malicious' WHEN bad OR is_scoped OR l.ecosystem = 'pypi' AND l.name = 'none' THEN 'not_checked' WHEN error IS NOT NULL OR ex IS NULL THEN 'unavailable' WHEN ex THEN 'resolved' ELSE 'nonexistent_package' END AS verdict
 FROM l LEFT JOIN b USING (ecosystem, norm_name) LEFT JOIN j USING (ecosystem, norm_name)), hs AS (SELECT *, CASE ecosystem WHEN 'npm' THEN 'registry.npmjs.org' ELSE 'pypi.org' END AS host FROM v)"""


def _checked(spark, sf_dir):
    return dp.registry_checks(frame(spark, sf_dir, "deps"), frame(spark, sf_dir, "advisories"), _resolved(spark, sf_dir), [])


@query(f"""WITH {_CHECKED} SELECT DISTINCT 'other' AS kind, CASE verdict WHEN 'sensitive_suppressed' THEN 'registry check suppressed a credential-shaped package coordinate' WHEN 'non_registry_suppressed' THEN 'registry check skipped a non-registry dependency source'
 ELSE CASE error WHEN 'rate_limited' THEN 'package registry rate limited at ' WHEN 'invalid_response' THEN 'package registry returned an invalid response at ' ELSE 'package registry unavailable at ' END || host END AS message FROM hs WHERE verdict IN ('sensitive_suppressed', 'non_registry_suppressed', 'unavailable')
 UNION SELECT 'other', 'OSV snapshot unavailable for PyPi'""")
def registry_warnings(spark, sf_dir):
    """What could not be checked, each once."""
    return dp.registry_warnings(_checked(spark, sf_dir), spark.createDataFrame([("pypi",)], "ecosystem string"))


@query(f"""WITH {_CHECKED}, s AS (SELECT * FROM hs WHERE verdict IN ('resolved', 'nonexistent_package', 'unavailable') AND request_made), f AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, norm_name ORDER BY name, version_req) AS k FROM s)
SELECT DISTINCT host AS endpoint, name || '@' || version_req AS package, CASE verdict WHEN 'resolved' THEN 200 WHEN 'nonexistent_package' THEN 404 ELSE CASE error WHEN 'rate_limited' THEN 429 WHEN 'invalid_response' THEN status END END AS status,
 CASE verdict WHEN 'resolved' THEN 'registry_resolved' WHEN 'nonexistent_package' THEN 'not_found' ELSE CASE WHEN error IN ('rate_limited', 'invalid_response') THEN 'invalid_response' ELSE 'transport_error' END END AS outcome FROM f WHERE k = 1""")
def registry_actions(spark, sf_dir):
    """The names that were asked for, and what came back."""
    return dp.registry_actions(_checked(spark, sf_dir)).select("endpoint", "package", "status", "outcome")


@query(f"""WITH {_CHECKED} SELECT DISTINCT CASE ecosystem WHEN 'npm' THEN 'npm' ELSE 'PyPI' END || ' package names sent to ' || host AS summary FROM hs WHERE verdict IN ('resolved', 'nonexistent_package', 'unavailable') AND request_made""")
def name_egress(spark, sf_dir):
    """Where names were sent to."""
    return dp.name_egress(_checked(spark, sf_dir)).select(egress_summary(F.col("ecosystem"), F.col("host")).alias("summary"))


@query(f"""WITH {_CHECKED}, k AS (SELECT ecosystem, name, version_req, 'KnownMalicious' AS reason FROM hs WHERE verdict = 'known_malicious' UNION ALL
 SELECT ecosystem, name, version_req, 'NonexistentPackage' FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, norm_name ORDER BY name, version_req) AS n FROM hs WHERE verdict = 'nonexistent_package') WHERE n = 1),
m AS (SELECT d.ecosystem, CASE d.ecosystem WHEN 'npm' THEN d.name ELSE lower(regexp_replace(d.name, '[-_.]+', '-', 'g')) END AS norm_name, d.name, d.version_req, d.path FROM deps d JOIN hs USING (ecosystem, name, version_req) WHERE verdict IN ('known_malicious', 'nonexistent_package'))
SELECT 'dependency-' || substr(sha256(CASE ecosystem WHEN 'npm' THEN 'Npm' ELSE 'PyPi' END || chr(0) || name || chr(0) || version_req || chr(0) || reason), 1, 24) AS id, CASE reason WHEN 'KnownMalicious' THEN 'critical' ELSE 'high' END AS severity, CASE reason WHEN 'KnownMalicious' THEN 'Known-malicious dependency: ' ELSE 'Package does not resolve publicly: ' END || name AS title,
 CAST(CASE reason WHEN 'KnownMalicious' THEN (SELECT count(DISTINCT path) FROM m WHERE m.ecosystem = k.ecosystem AND m.name = k.name AND m.version_req = k.version_req) ELSE (SELECT count(DISTINCT path) FROM m WHERE m.ecosystem = k.ecosystem AND m.norm_name = CASE k.ecosystem WHEN 'npm' THEN k.name ELSE lower(regexp_replace(k.name, '[-_.]+', '-', 'g')) END) END AS INTEGER) AS n_places FROM k""")
def registry_findings(spark, sf_dir):
    """Dependencies that are known to be malicious, or that no public registry knows."""
    return dp.registry_findings(_checked(spark, sf_dir)).select("id", "severity", "title", F.size("locations").alias("n_places"))
