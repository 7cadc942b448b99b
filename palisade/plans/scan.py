"""The whole scan: files to units to candidates to findings to a result."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.location import source_scope
from palisade.functions.rules import DEFAULT, Ruleset
from palisade.functions.text import normalized_url
from palisade.operators import dependencies as dp
from palisade.operators import harvest, rls
from palisade.operators.coalesce import coalesced
from palisade.operators.correlate import finalize, ranked, scan_stats
from palisade.operators.detect import detect
from palisade.operators.ignore import ignored_paths
from palisade.operators.keys import findings_of
from palisade.operators.units import collect_units, counters, scannable, skipped
from palisade.plans.shared import checkpointed

VERSION = "0.2.0"
_ACTIONS = "kind string, intent string, endpoint string, table string, package string, status int, outcome string, observed_rows long"


@dataclass
class Registry:
    """Recorded facts of registries: advisories(ecosystem, norm_name, version), answers(ecosystem, norm_name, status); a cache(key, fetched_at, exists) with the second that is now; archives(ecosystem) that cannot be used."""

    advisories: DataFrame
    answers: DataFrame
    cache: DataFrame | None = None
    now: int = 0
    unavailable: DataFrame | None = None
    environment: dict[str, str] = field(default_factory=dict)


@dataclass
class Probes:
    """Recorded answers: responses(url, status, body, error) to reads of tables, roots(project_url, status, body, error) to API descriptions."""

    responses: DataFrame
    roots: DataFrame


@dataclass
class Catalog:
    """Facts of one project's database: tables, policies, grants, as introspect() takes them."""

    project_url: str
    tables: DataFrame
    policies: DataFrame
    grants: DataFrame


@dataclass
class Scan:
    findings: DataFrame
    #: name, value
    stats: DataFrame
    dependencies: DataFrame
    #: kind, message
    warnings: DataFrame
    actions: DataFrame
    egress: DataFrame
    scope: dict
    started_at: str
    duration_ms: int
    version: str = VERSION


def secret_findings(units: DataFrame, ruleset: Ruleset = DEFAULT) -> DataFrame:
    """Coalesced findings of units; nothing raw leaves."""
    return coalesced(findings_of(detect(units, ruleset)))


def associations(units: DataFrame, keys: DataFrame) -> DataFrame:
    """scope, name, project_url, reason of the tables that units refer to; keys as findings_of() gives them."""
    scopes = F.array_distinct(F.transform("locations", lambda x: source_scope(x["path"])))
    facts = keys.where("key_class IS NOT NULL AND project_url IS NOT NULL").select("content_id", F.explode(scopes).alias("scope"), "project_url").distinct()
    return harvest.associate(harvest.references(units), facts)


def scan(
    files: DataFrame, ruleset: Ruleset = DEFAULT, baseline: DataFrame | None = None, config_skip: tuple[str, ...] = (), registry: Registry | None = None, probes: Probes | None = None, catalog: Catalog | None = None,
    warnings: DataFrame | None = None, scope: dict | None = None,
) -> Scan:
    """files(path, content, prov_kind, sha, author, date); warnings(kind, message) are those of whoever collected them."""
    started, began = datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z"), time.monotonic()
    spark = files.sparkSession
    marked = files.join(ignored_paths(files).withColumn("ignored", F.lit(True)), "path", "left")
    ignored = F.coalesce("ignored", F.lit(False))
    kept = scannable(marked, ruleset.max_bytes, config_skip, ignored).drop("ignored")
    units = collect_units(kept)
    said = [skipped(marked, ruleset.max_bytes, config_skip, ignored)] + ([warnings] if warnings is not None else [])
    actions = [spark.createDataFrame([], _ACTIONS)]
    egress = spark.createDataFrame([], "ecosystem string, host string")

    # Files are read and searched once; raw values end before this checkpoint.
    own = checkpointed(findings_of(detect(units, ruleset)))
    found = [coalesced(own)]
    tree = files.where("prov_kind = 'working_tree'")
    deps = dp.dependencies(tree)
    checks = dp.structural(deps.where("error IS NULL"))
    found.append(dp.structural_findings(checks))
    if registry is not None:
        answers = dp.resolutions_of(registry.answers)
        if registry.cache is not None:
            answers = dp.with_cache(answers, registry.cache, registry.now)
        verdicts = checkpointed(dp.registry_checks(dp.eligible(deps.where("error IS NULL"), checks), registry.advisories, answers, dp.private_registries(tree, registry.environment)))
        found.append(dp.registry_findings(verdicts))
        said.append(dp.registry_warnings(verdicts, registry.unavailable))
        actions.append(dp.registry_actions(verdicts))
        egress = dp.name_egress(verdicts)
    if probes is not None or catalog is not None:
        known = checkpointed(associations(units, own))
        told = F.concat(F.lit("API reference "), "name", F.lit(" in "), "scope", F.lit(" is not checked: "), "reason")
        said.append(known.where("reason IS NOT NULL").select(F.lit("other").alias("kind"), told.alias("message")).distinct())
        named = known.where("project_url IS NOT NULL").select("project_url", F.col("name").alias("table"))
        if probes is not None:
            inputs = checkpointed(rls.probe_inputs(found[0], named))
            good = inputs.where(rls.project_ok(F.col("project_url")))
            bad = inputs.where(~rls.project_ok(F.col("project_url"))).select(F.lit("other").alias("kind"), F.concat(F.lit("Tier 0 RLS read probe transport/other error for "), "project_url", F.lit(": invalid project URL")).alias("message"))
            roots = checkpointed(rls.root_outcomes(good, probes.roots))
            described = rls.openapi_tables(probes.roots.where("status = 200").withColumn("project_url", normalized_url(F.col("project_url"))).join(roots.where("outcome = 'root_enumerated'").select("project_url"), "project_url", "left_semi"))
            tables = rls.candidate_tables(good.select("project_url", F.explode("tables").alias("table")), described)
            outcomes = checkpointed(rls.probe(tables, probes.responses))
            grouped = good.select("project_url").join(tables.groupBy("project_url").agg(F.collect_set("table").alias("tables")), "project_url", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))
            found.append(rls.probe_findings(outcomes, good))
            said += [bad, rls.probe_warnings(outcomes, roots, grouped).select(F.lit("other").alias("kind"), "message")]
            actions.append(rls.probe_actions(outcomes, roots))
        if catalog is not None:
            url = normalized_url(F.lit(catalog.project_url))
            candidates = named.where(normalized_url(F.col("project_url")) == url).select("project_url", F.col("table").alias("candidate")).distinct()
            found.append(rls.policy_findings(rls.introspect(candidates, catalog.tables, catalog.policies, catalog.grants)))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # Correlation reads findings several times.
    final = checkpointed(finalize(checkpointed(rows), baseline))
    notes = said[0]
    for more in said[1:]:
        notes = notes.unionByName(more)
    notes = checkpointed(notes.distinct())
    acted = actions[0]
    for more in actions[1:]:
        acted = acted.unionByName(more)
    where = {"target": ".", "working_tree": True, "history": False, "max_commits": None, "scanned_commits": 0, "truncated": False} | (scope or {})
    where |= {"network": registry is not None or probes is not None or catalog is not None, "registry_checks": registry is not None, "tier0_read_probe": probes is not None, "tier1_introspection": catalog is not None}
    numbers = checkpointed(scan_stats(final, counters(kept), notes))
    return Scan(ranked(final), numbers, dp.listed(deps), notes, checkpointed(acted.distinct()), checkpointed(egress), where, started, int(1000 * (time.monotonic() - began)))
