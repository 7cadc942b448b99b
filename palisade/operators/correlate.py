"""What findings mean together, and what is left to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.keys import ELEVATED, PUBLIC
from palisade.functions.rank import CATEGORIES, SEVERITIES, category_rank, location_rank, severity_rank
from palisade.functions.text import normalized_url
from palisade.operators.findings import finding, sorted_places

CHAIN, ELEVATED_RULE = "exposed-public-key-chain", "elevated-key-in-tree"
#: Rules whose composites take the place of what they name.
ABSORBING = (CHAIN,)


def _committed(locations: str = "locations") -> Column:
    return F.exists(locations, lambda x: (x["prov_kind"] == "commit") | F.exists(x["shas"], lambda s: s != ""))


def _reachable(locations: str = "locations") -> Column:
    return F.coalesce(F.array_max(F.transform(locations, lambda x: location_rank(x["location_class"]))) == 2, F.lit(False))


def public_chain(findings: DataFrame) -> DataFrame:
    """A composite for each public key that browsers or history hold and each table of its project that it can read, as its reproduction shows."""
    keys = findings.where(F.col("key_class").isin(*PUBLIC) & F.col("project_url").isNotNull() & (_reachable() | _committed())).select(F.col("id").alias("key_id"), F.col("locations").alias("key_locations"), normalized_url(F.col("project_url")).alias("project"))
    rls = findings.where((F.col("category") == "rls") & F.col("reproduction").isNotNull()).select(F.col("id").alias("rls_id"), F.col("locations").alias("rls_locations"), "table", "reproduction", normalized_url(F.col("project_url")).alias("project"))
    related = F.array("key_id", "rls_id")
    out = keys.join(rls, "project")
    return _composite(
        out, CHAIN, related, F.concat("key_locations", "rls_locations"), confidence=F.lit("confirmed"), table=F.col("table"), reproduction=F.col("reproduction"),
        title=F.concat(F.lit("Public Supabase key can read unprotected table "), F.col("table")),
        detail=F.lit("A browser-reachable Supabase public key is present and an API-exposed table on the same project is readable without additional authorization."),
        remediation=F.lit("Fix RLS policies for the exposed table, then rotate affected keys if exposure is confirmed."),
    )


def elevated_key(findings: DataFrame) -> DataFrame:
    """A composite for each committed elevated key whose project has any finding on access rules."""
    keys = findings.where(F.col("key_class").isin(*ELEVATED) & F.col("project_url").isNotNull() & _committed()).select(F.col("id").alias("key_id"), "locations", normalized_url(F.col("project_url")).alias("project"))
    rls = findings.where(F.col("category") == "rls").select(normalized_url(F.col("project_url")).alias("project"), F.col("id").alias("rls_id"))
    named = keys.select("key_id", "project").join(rls, "project").groupBy("key_id").agg(F.collect_set("rls_id").alias("rls_ids"))
    out = keys.join(named, "key_id")
    related = F.array_sort(F.array_distinct(F.concat(F.array("key_id"), F.col("rls_ids"))))
    return _composite(
        out, ELEVATED_RULE, related, F.col("locations"), confidence=F.lit("likely"), title=F.lit("Exposed elevated Supabase key bypasses RLS"),
        detail=F.lit("An elevated Supabase key is committed for this project. RLS findings on the same project are moot until this key is rotated because elevated keys bypass RLS entirely."),
        remediation=F.lit("Rotate and remove the elevated key first, then reassess remaining RLS findings."),
    )


def _composite(rows: DataFrame, rule: str, related: Column, locations: Column, **given: Column) -> DataFrame:
    identity = F.concat(F.lit("correlation-"), F.substring(F.sha2(F.concat_ws("\0", F.lit(rule), F.array_sort(related)).cast("binary"), 256), 1, 24))
    shown = F.concat_ws(": ", F.lit(rule), given.get("reproduction", F.lit(None).cast("string")))
    given.pop("reproduction", None)
    return finding(rows, id=identity, category=F.lit("correlation"), severity=F.lit("critical"), rule_id=F.lit(rule), evidence=shown, project_url=F.col("project"), locations=sorted_places(locations), related=related, **given)


#: Rules of correlation, in order: from findings to composites.
RULES = (public_chain, elevated_key)


def correlate(findings: DataFrame) -> DataFrame:
    out = None
    for rule in RULES:
        found = rule(findings)
        out = found if out is None else out.unionByName(found)
    return out


def finalize(findings: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Findings and their composites: one row for each id, without those of the baseline, then without those that composites stand for."""
    rows = one_each(findings.unionByName(correlate(findings)))
    if baseline is not None:
        rows = suppressed(rows, baseline)
    absorbed = rows.where((F.col("category") == "correlation") & F.col("rule_id").isin(*ABSORBING)).select(F.explode("related").alias("id")).distinct().withColumn("absorbed", F.lit(True))
    return rows.join(absorbed, "id", "left").where((F.col("category") == "correlation") | F.col("absorbed").isNull()).drop("absorbed")


def one_each(findings: DataFrame) -> DataFrame:
    """One row for each id; of equal ids the one that is first by its columns, so the same on every run."""
    rest = [c for c in findings.columns if c != "id"]
    return findings.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", "x.*")


def suppressed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """findings without those whose id the baseline names."""
    return findings.join(baseline.select("id").distinct(), "id", "left_anti")


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), category_rank(F.col("category")), "id")


def stats(findings: DataFrame) -> DataFrame:
    """Findings by category and severity."""
    return findings.groupBy("category", "severity").agg(F.count("*").alias("findings"))


def scan_stats(findings: DataFrame, collected: DataFrame, warnings: DataFrame) -> DataFrame:
    """name, value: what was collected, findings by severity and by category, what was skipped, whether a budget was hit (1 or 0).

    collected is counters()'s row; warnings has kind.
    """

    def named(rows: DataFrame, *values: Column) -> DataFrame:
        out = rows.agg(*values)
        return out.unpivot([], [f"`{c}`" for c in out.columns], "name", "value")

    by = [F.count_if(F.col("severity") == x).alias(f"by_severity.{x}") for x in SEVERITIES] + [F.count_if(F.col("category") == x).alias(f"by_category.{x}") for x in CATEGORIES]
    kinds = {"skipped_large_files": "large_file_skipped", "skipped_binary_files": "binary_file_skipped"}
    skipped = [F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()] + [F.coalesce(F.max((F.col("kind") == "history_budget_hit").cast("long")), F.lit(0).cast("long")).alias("scan_budget_hit")]
    got = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("paths_seen", "blobs_read", "unique_contents")]
    return named(findings, F.count("*").alias("findings"), *by).unionByName(named(collected, *got)).unionByName(named(warnings, *skipped))


def gate(findings: DataFrame, severity: str) -> DataFrame:
    """One row: exit_code 1 if any finding is at least that severe, else 0."""
    least = severity_rank(F.lit(severity))
    return findings.agg(F.coalesce(F.max((severity_rank(F.col("severity")) >= least).cast("int")), F.lit(0)).alias("exit_code"))
