"""Dependency manifests: parsing, structural checks, private registries, registry facts with their cache."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.rank import ECOSYSTEM_NAMES, REASON_NAMES, mapped
from palisade.functions.text import stable_id
from palisade.operators.findings import finding, place

# Manifests by file name, and the sections read.
MANIFESTS = ("package.json", "package-lock.json", "poetry.lock", "uv.lock", "pyproject.toml", "requirements.txt")
SKIPPED_FOLDERS = ("node_modules", ".git", "target", "vendor")
SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
_DDL = "path string, section string, name string, version_req string, has_version boolean, ecosystem string, is_scoped boolean, check boolean, error string"


def manifests(files: DataFrame) -> DataFrame:
    """Files(path, content) that are manifests, outside the skipped folders, whatever the ignore files say."""
    folders = F.split(F.regexp_replace("path", "[^/]*$", ""), "/")
    return files.where(F.is_valid_utf8("content") & F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))))


def _npm(spec) -> tuple[str, bool]:
    v = spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None
    return (v, True) if isinstance(v, str) else ("", False)


def _requirement(line: str) -> tuple[str, str] | None:
    r = line.split("#", 1)[0].strip()
    if not r or r.startswith(("-", "git+")) or "://" in r:
        return None
    cut = min((i for i in (r.find(c) for c in "=<>!~[") if i >= 0), default=len(r))
    name = r[:cut].strip()
    return name, r[len(name) :].strip()


def read_manifest(path: str, text: str) -> Iterator[tuple]:
    """(section, name, version_req, has_version, ecosystem, is_scoped, check) of each dependency."""
    kind = path.rsplit("/", 1)[-1]
    if kind == "package.json":
        found = json.loads(text)
        for s in SECTIONS:
            deps = found.get(s) if isinstance(found, dict) else None
            for n, v in deps.items() if isinstance(deps, dict) else ():
                yield s, n, *_npm(v), "npm", n.startswith("@"), True
    elif kind == "package-lock.json":
        found = json.loads(text)
        packages = found.get("packages") if isinstance(found, dict) else None
        if isinstance(packages, dict):
            for p, v in packages.items():
                n = p.removeprefix("node_modules/")
                if n != p and n and "/node_modules/" not in n:
                    yield "lockfile packages", n, *_npm(v), "npm", n.startswith("@"), True
        elif isinstance(found, dict) and isinstance(found.get("dependencies"), dict):
            for n, v in found["dependencies"].items():
                yield "lockfile dependencies", n, *_npm(v), "npm", n.startswith("@"), True
    elif kind in ("poetry.lock", "uv.lock"):
        for p in tomllib.loads(text).get("package", ()):
            if isinstance(p.get("name"), str) and isinstance(p.get("version"), str):
                yield "lock", p["name"], p["version"], True, "pypi", False, False
    elif kind == "pyproject.toml":
        found = tomllib.loads(text)
        for r in found.get("project", {}).get("dependencies", ()):
            if isinstance(r, str) and (x := _requirement(r)):
                yield "project.dependencies", *x, True, "pypi", False, True
        for n, v in found.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
            if n != "python":
                yield "tool.poetry.dependencies", n, *_npm(v), "pypi", False, True
    elif kind == "requirements.txt":
        for line in text.splitlines():
            if x := _requirement(line):
                yield "requirements.txt", *x, True, "pypi", False, True


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _DDL.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                rows += [(path, *x, None) for x in read_manifest(path, text or "")]
            except (ValueError, AttributeError, TypeError) as e:
                rows.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies declared in files(path, content); manifests that cannot be parsed give one row with error."""
    return manifests(files).select("path", "content").mapInArrow(_parse, _DDL)


def listed(deps: DataFrame) -> DataFrame:
    """Dependencies each once, in the order of all their columns."""
    rows = deps.where("error IS NULL").distinct()
    return rows.orderBy(*rows.columns)


# Public registries, settings that name others, and by whom they are read.
PUBLIC_NPM = ("https://registry.npmjs.org", "http://registry.npmjs.org")
PUBLIC_PYTHON = ("https://pypi.org/simple", "http://pypi.org/simple")
PYTHON_INDEX = ("--index-url", "--extra-index-url", "index-url", "extra-index-url")
HOSTS = {"npm": "registry.npmjs.org", "pypi": "pypi.org"}


def _other(url: Column, public: tuple[str, ...]) -> Column:
    return ~F.regexp_replace(F.trim(url), "/+$", "").isin(*public)


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether pyproject texts name an index of their own."""
    for batch in batches:
        out = []
        for text in batch.column("content").to_pylist():
            try:
                tool = tomllib.loads(text or "").get("tool", {})
                poetry = tool.get("poetry", {}).get("source")
                out.append(isinstance(poetry, list) and bool(poetry) or "index" in tool.get("uv", {}))
            except (ValueError, AttributeError):
                out.append(False)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.bool_())], ["own"])


def private_registries(files: DataFrame, environment: dict[str, str] | None = None) -> DataFrame:
    """ecosystem: those whose packages may come from a registry of one's own, by files(path, content) and the environment.

    .npmrc at the root or beside a package.json; pip.conf at the root; index lines of requirements.txt; sources of pyproject.toml.
    """
    env = environment or {}
    said = []
    if "NPM_CONFIG_REGISTRY" in env and env["NPM_CONFIG_REGISTRY"].strip().rstrip("/") not in PUBLIC_NPM:
        said.append("npm")
    if any(env[k].strip().rstrip("/") not in PUBLIC_PYTHON for k in ("PIP_INDEX_URL", "UV_INDEX_URL") if k in env) or env.get("PIP_EXTRA_INDEX_URL", "").strip():
        said.append("pypi")
    folder, name = F.regexp_replace("path", "[^/]*$", ""), F.regexp_extract("path", "[^/]*$", 0)
    known, files = manifests(files), files.where(F.is_valid_utf8("content"))
    rows = F.transform(F.split("content", "\n"), lambda x: F.trim(x))
    npmrc = files.where(name == ".npmrc").withColumn("folder", folder).where(F.exists(rows, lambda x: x.startswith("registry=") & _other(F.substring(x, 10, 1 << 20), PUBLIC_NPM)))
    beside = known.where(name == "package.json").select(folder.alias("folder")).distinct()
    npm = npmrc.where("folder = ''").select("folder").unionByName(npmrc.join(beside, "folder", "left_semi").select("folder")).select(F.lit("npm").alias("ecosystem"))

    def index_line(x: Column) -> Column:
        out = F.lit(False)
        for start in PYTHON_INDEX:
            out = out | x.startswith(start)
        return out

    lines = files.where(F.col("path") == "pip.conf").select("content").unionByName(known.where(name == "requirements.txt").select("content"))
    pip = lines.where(F.exists(rows, index_line)).select(F.lit("pypi").alias("ecosystem"))
    project = known.where(name == "pyproject.toml").select("content").mapInArrow(_sources, "own boolean").where("own").select(F.lit("pypi").alias("ecosystem"))
    given = files.sparkSession.createDataFrame([(x,) for x in said], "ecosystem string")
    return npm.unionByName(pip).unionByName(project).unionByName(given).distinct()


def eligible(deps: DataFrame, checks: DataFrame) -> DataFrame:
    """Dependencies without those that structural() rejects, by name and manifest."""
    return deps.join(checks.select("name", "path").distinct(), ["name", "path"], "left_anti")


def npm_name_ok(name: Column) -> Column:
    return (F.octet_length(name) <= 214) & name.rlike(r"^(?:@[a-z0-9._-]+/)?[a-z0-9._-]+\z") & ~name.rlike(r"^[._]")


def python_name_ok(name: Column) -> Column:
    return F.trim(name).rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?\z")


def structural(deps: DataFrame) -> DataFrame:
    """id, path, name, reason, detail of names and versions that no registry can resolve; deps as dependencies() returns them."""
    ok = F.when(F.col("ecosystem") == "npm", npm_name_ok(F.col("name"))).otherwise(python_name_ok(F.col("name")))
    kind = F.when(F.col("ecosystem") == "npm", F.lit("npm")).otherwise(F.lit("Python"))
    bad_name = F.when(~ok, F.struct(F.lit("invalid_package_name").alias("reason"), F.concat(F.lit("invalid "), kind, F.lit(" package name in "), F.col("section")).alias("detail")))
    empty = F.when((F.col("ecosystem") == "npm") & F.col("has_version") & (F.trim("version_req") == ""), F.struct(F.lit("empty_version_specifier").alias("reason"), F.concat(F.lit("empty version specifier in "), F.col("section")).alias("detail")))
    rows = deps.where("check").select("path", "name", F.explode(F.filter(F.array(bad_name, empty), lambda x: x.isNotNull())).alias("f")).select("path", "name", "f.*")
    return rows.withColumn("id", stable_id("dependency", F.col("path"), F.col("name"), F.col("detail"))).distinct()


def structural_findings(checks: DataFrame) -> DataFrame:
    """structural() rows in the form of findings."""
    shown = F.concat(mapped(F.col("reason"), REASON_NAMES), F.lit(" dependency "), F.col("name"), F.lit(" in "), F.col("path"))
    return finding(
        checks, id=F.col("id"), category=F.lit("dependency_integrity"), severity=F.lit("high"), confidence=F.lit("review"), rule_id=F.col("reason"), title=F.concat(F.lit("Dependency requires review: "), F.col("name")), detail=F.col("detail"),
        remediation=F.lit("Correct or remove the dependency before install or deployment."), evidence=shown, locations=F.array(place(F.col("path"), "server_only")),
    )


def normalized_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "npm", name).otherwise(F.lower(F.regexp_replace(name, "[-_.]+", "-")))


def exact_version(ecosystem: Column, requirement: Column) -> Column:
    v = F.trim(requirement)
    v = F.when(ecosystem == "npm", F.regexp_replace(v, "^=", "")).otherwise(F.regexp_replace(v, "^==", ""))
    return F.when(v.rlike(r"^[0-9][A-Za-z0-9.+-]*\z"), v)


# What makes a coordinate look like a credential, and sources that are no registry.
SECRET_MARKERS = ("sb_secret_", "service_role", "sk_live_", "sk-proj-", "github_pat_", "ghp_", "-----begin")
OTHER_SOURCES = ("git+", "git:", "file:", "link:", "workspace:", "github:", "http:", "https:")


def coordinate(name: Column, requirement: Column) -> Column:
    return F.concat(name, F.lit("@"), requirement)


def may_hold_secret(name: Column, requirement: Column) -> Column:
    text = F.lower(coordinate(name, requirement))
    out = text.rlike(r"(?:^|[^a-z0-9])akia[a-z0-9]{16,}")
    for marker in SECRET_MARKERS:
        out = out | F.contains(text, F.lit(marker))
    return out


def from_registry(requirement: Column) -> Column:
    v = F.lower(F.trim(requirement))
    out = (v != "") & ~F.contains(v, F.lit("://"))
    for source in OTHER_SOURCES:
        out = out & ~v.startswith(source)
    return out


def resolutions_of(responses: DataFrame) -> DataFrame:
    """ecosystem, norm_name, exists, error, status from recorded answers responses(ecosystem, norm_name, status): 2xx, 404, 429, others; a null status is no answer."""
    status = F.col("status")
    ok = status.between(200, 299)
    error = F.when(status.isNull(), "unavailable").when(ok | (status == 404), F.lit(None)).when(status == 429, "rate_limited").otherwise("invalid_response")
    return responses.select("ecosystem", "norm_name", F.when(ok, True).when(status == 404, False).alias("exists"), error.alias("error"), "status")


def cache_key(ecosystem: Column, name: Column) -> Column:
    """What a cached answer is filed under."""
    return F.sha2(F.concat_ws("\0", mapped(ecosystem, ECOSYSTEM_NAMES), normalized_name(ecosystem, name)).cast("binary"), 256)


#: Seconds for which a cached answer counts.
TTL = 24 * 3600


def fresh(fetched_at: Column, now: Column, ttl: int = TTL) -> Column:
    """Whether an answer of that second still counts; one from the future does."""
    return F.greatest(now - fetched_at, F.lit(0)) <= ttl


def with_cache(answers: DataFrame, cache: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Answers as resolutions_of() gives them, with request_made: fresh rows of cache(key, fetched_at, exists) come first and need no request."""
    known = cache.where(fresh(F.col("fetched_at"), F.lit(now), ttl)).groupBy("key").agg(F.max_by("exists", "fetched_at").alias("cached"))
    rows = answers.withColumn("key", cache_key(F.col("ecosystem"), F.col("norm_name"))).join(known, "key", "left")
    hit = F.col("cached").isNotNull()
    return rows.select("ecosystem", "norm_name", F.coalesce("cached", "exists").alias("exists"), F.when(~hit, F.col("error")).alias("error"), F.when(~hit, F.col("status")).alias("status"), (~hit).alias("request_made"))


def cache_rows(answers: DataFrame, now: int) -> DataFrame:
    """key, fetched_at, exists: what answers without an error add to the cache (write them with Spark's own committer)."""
    return answers.where("error IS NULL AND exists IS NOT NULL").select(cache_key(F.col("ecosystem"), F.col("norm_name")).alias("key"), F.lit(now).cast("long").alias("fetched_at"), "exists")


def registry_checks(deps: DataFrame, advisories: DataFrame, resolutions: DataFrame, private: DataFrame | list[str]) -> DataFrame:
    """ecosystem, name, version_req, verdict, manifests, id, status, error, request_made for each distinct dependency.

    advisories(ecosystem, norm_name, version); resolutions(ecosystem, norm_name, exists, error, and if known status, request_made)
    are recorded, of several for a name the first by exists, error and status counts. A name that an
    exact version marks as malicious is not looked up; scoped names and private ecosystems are not either. Verdicts:
    sensitive_suppressed, non_registry_suppressed, known_malicious, not_checked, nonexistent_package, resolved, unavailable.
    """
    eco = F.col("ecosystem")
    own = private if isinstance(private, DataFrame) else deps.sparkSession.createDataFrame([(x,) for x in private], "ecosystem string")
    rows = deps.groupBy("ecosystem", "name", "version_req", "is_scoped").agg(F.array_sort(F.collect_set("path")).alias("manifests"))
    rows = rows.withColumns({"norm_name": normalized_name(eco, F.col("name")), "version": exact_version(eco, F.col("version_req"))})
    sensitive, plain = may_hold_secret(F.col("name"), F.col("version_req")), from_registry(F.col("version_req"))
    checkable = ~sensitive & plain
    listed_ = advisories.select("ecosystem", "norm_name", "version").distinct().withColumn("listed", F.lit(True))
    rows = rows.join(listed_, ["ecosystem", "norm_name", "version"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)) & checkable)
    bad = rows.where("listed").select("ecosystem", "norm_name").distinct().withColumn("bad", F.lit(True))
    more = {"status": F.lit(None).cast("int"), "request_made": F.lit(True)}
    answers = resolutions.select("ecosystem", "norm_name", "exists", "error", *((F.col(c) if c in resolutions.columns else v).alias(c) for c, v in more.items()))
    known = answers.groupBy("ecosystem", "norm_name").agg(F.min(F.struct("exists", "error", "status", "request_made")).alias("r")).select("ecosystem", "norm_name", "r.*")
    # At most one row for each ecosystem.
    rows = rows.join(bad, ["ecosystem", "norm_name"], "left").join(known, ["ecosystem", "norm_name"], "left").join(F.broadcast(own.distinct().withColumn("own", F.lit(True))), "ecosystem", "left")
    verdict = (
        F.when(sensitive, "sensitive_suppressed").when(~plain, "non_registry_suppressed").when(F.col("listed"), "known_malicious")
        .when(F.col("bad") | F.col("is_scoped") | F.col("own"), "not_checked")
        .when(F.col("error").isNotNull() | F.col("exists").isNull(), "unavailable").when(F.col("exists"), "resolved").otherwise("nonexistent_package")
    )
    out = rows.withColumn("verdict", verdict)
    flagged = F.col("verdict").isin("known_malicious", "nonexistent_package")
    identity = F.when(flagged, stable_id("dependency", mapped(eco, ECOSYSTEM_NAMES), F.col("name"), F.col("version_req"), mapped(F.col("verdict"), REASON_NAMES)))
    return out.select("ecosystem", "name", "norm_name", "version_req", "verdict", "manifests", identity.alias("id"), "status", "error", F.coalesce("request_made", F.lit(True)).alias("request_made"))


def registry_findings(checks: DataFrame) -> DataFrame:
    """registry_checks() rows that are findings, in their form; a nonexistent name counts once, in its smallest version, with the manifests of all."""
    rows = checks.where("id IS NOT NULL")
    missing = rows.where("verdict = 'nonexistent_package'").groupBy("ecosystem", "norm_name").agg(F.min(F.struct("name", "version_req", "id")).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("manifests")))).alias("manifests"))
    missing = missing.select("ecosystem", "f.name", "f.version_req", F.lit("nonexistent_package").alias("verdict"), "manifests", "f.id")
    rows = rows.where("verdict = 'known_malicious'").select("ecosystem", "name", "version_req", "verdict", "manifests", "id").unionByName(missing)
    at, bad = coordinate(F.col("name"), F.col("version_req")), F.col("verdict") == "known_malicious"
    gone = F.concat(at, F.lit(" returned not found from the public "), mapped(F.col("ecosystem"), ECOSYSTEM_NAMES), F.lit(" registry and may be hallucinated or vulnerable to slopsquatting."))
    return finding(
        rows, id=F.col("id"), category=F.lit("dependency_integrity"), severity=F.when(bad, "critical").otherwise("high"), confidence=F.lit("confirmed"), rule_id=F.col("verdict"),
        title=F.concat(F.when(bad, "Known-malicious dependency: ").otherwise("Package does not resolve publicly: "), F.col("name")),
        detail=F.when(bad, F.concat(at, F.lit(" matches the locally cached OSV advisory snapshot."))).otherwise(gone),
        remediation=F.when(bad, "Remove or upgrade the dependency to a version not affected by the advisory, then regenerate and review the lockfile.").otherwise("Verify the intended public package name before install; correct or remove the declaration and regenerate the lockfile."),
        evidence=F.concat(mapped(F.col("verdict"), REASON_NAMES), F.lit(" dependency "), at, F.lit(" in "), F.col("manifests")[0]), locations=F.transform("manifests", lambda p: place(p, "server_only")),
    )


def registry_warnings(checks: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """kind, message of what could not be checked, each once; snapshots(ecosystem) are those whose advisories are unavailable."""
    host = mapped(F.col("ecosystem"), HOSTS)
    message = (
        F.when(F.col("verdict") == "sensitive_suppressed", "registry check suppressed a credential-shaped package coordinate").when(F.col("verdict") == "non_registry_suppressed", "registry check skipped a non-registry dependency source")
        .when((F.col("verdict") == "unavailable") & (F.col("error") == "rate_limited"), F.concat(F.lit("package registry rate limited at "), host)).when((F.col("verdict") == "unavailable") & (F.col("error") == "invalid_response"), F.concat(F.lit("package registry returned an invalid response at "), host))
        .when(F.col("verdict") == "unavailable", F.concat(F.lit("package registry unavailable at "), host))
    )
    out = checks.select(message.alias("message"))
    if snapshots is not None:
        out = out.unionByName(snapshots.select(F.concat(F.lit("OSV snapshot unavailable for "), mapped(F.col("ecosystem"), ECOSYSTEM_NAMES)).alias("message")))
    return out.where("message IS NOT NULL").distinct().select(F.lit("other").alias("kind"), "message")


def registry_actions(checks: DataFrame) -> DataFrame:
    """One row for each name that was asked for: kind, intent, endpoint, table, package, status, outcome, observed_rows."""
    outcome = F.when(F.col("verdict") == "resolved", "registry_resolved").when(F.col("verdict") == "nonexistent_package", "not_found").when(F.coalesce(F.col("error"), F.lit("unavailable")).isin("rate_limited", "invalid_response"), "invalid_response").otherwise("transport_error")
    status = F.when(F.col("verdict") == "resolved", 200).when(F.col("verdict") == "nonexistent_package", 404).when(F.col("error") == "rate_limited", 429).when(F.col("error") == "invalid_response", F.col("status"))
    asked = checks.where("verdict IN ('resolved', 'nonexistent_package', 'unavailable') AND request_made")
    first = asked.groupBy("ecosystem", "norm_name").agg(F.min(F.struct("name", "version_req", "verdict", "error", "status")).alias("x")).select("ecosystem", "x.*")
    none = F.lit(None)
    return first.select(
        F.lit("registry_existence").alias("kind"), F.lit("get").alias("intent"), mapped(F.col("ecosystem"), HOSTS).alias("endpoint"), none.cast("string").alias("table"), coordinate(F.col("name"), F.col("version_req")).alias("package"),
        status.cast("int").alias("status"), outcome.alias("outcome"), none.cast("long").alias("observed_rows"),
    ).distinct()


def name_egress(checks: DataFrame) -> DataFrame:
    """ecosystem, host: where names were sent to."""
    return checks.where("verdict IN ('resolved', 'nonexistent_package', 'unavailable') AND request_made").select("ecosystem", mapped(F.col("ecosystem"), HOSTS).alias("host")).distinct()
