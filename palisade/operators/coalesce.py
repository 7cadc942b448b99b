"""Findings that are the same secret become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.rank import KEY_CLASS_NAMES, mapped
from palisade.functions.text import stable_id
from palisade.operators.findings import finding, key_evidence, secret_evidence, sorted_places

BASE = ("category", "rule_or_class", "fingerprint", "severity")


def coalesced(findings: DataFrame, counted: bool = False) -> DataFrame:
    """One row for each secret and project, in the form of findings, with united locations and no related ids.

    With counted, also n_lines: how many lines, of each content at each path, hold the secret. Versions of a file that hold it at the same
    place can share a location, and a line that holds it twice has two.

    Rows are grouped by category, rule or class, fingerprint and severity. Where a group knows exactly one project, rows
    without one join it; otherwise there is a row for each project and one for those without. The member with the smallest id
    of its own gives the texts. Findings are read once and
    combined by group and project before the shuffle; projects are reconciled among the few rows that are left of a group.
    """
    head = F.struct("own_id", "rule_id", "confidence", "redacted", "key_class", "title", "detail", "remediation")
    best, places, more = F.min("head").alias("head"), F.flatten(F.collect_set("locations")).alias("locations"), []
    rows = findings.withColumn("head", head)
    if counted:
        # A secret has one project in a content, so no line is counted twice once projects are reconciled.
        rows = rows.groupBy(*BASE, "project_url", "content_id", F.col("locations")[0]["line"].alias("line")).agg(best, places)
        rows, more = rows.withColumn("n_lines", F.size(F.array_distinct("locations.path"))), [F.sum("n_lines").alias("n_lines")]
    each = rows.groupBy(*BASE, "project_url").agg(best, places, *more)
    group = Window.partitionBy(*BASE)
    low, high = F.min("project_url").over(group), F.max("project_url").over(group)
    each = each.withColumn("project_url", F.coalesce("project_url", F.when(low == high, low)))
    out = each.groupBy(*BASE, "project_url").agg(best, F.flatten(F.collect_list("locations")).alias("locations"), *more)
    prefix = F.when(F.col("rule_or_class").startswith("supabase-key:"), F.lit("supabase-key")).otherwise(F.lit("secret"))
    identity = stable_id(prefix, F.col("category"), F.col("rule_or_class"), F.col("fingerprint"), F.coalesce("project_url", F.lit("<none>")), F.col("severity"))
    redacted, mark, project = F.col("head.redacted"), F.col("fingerprint"), F.col("project_url")
    evidence = F.when(F.col("head.key_class").isNotNull(), key_evidence(mapped(F.col("head.key_class"), KEY_CLASS_NAMES), redacted, project, mark)).otherwise(secret_evidence(redacted, mark))
    same = {x: F.col(f"head.{x}") for x in ("confidence", "rule_id", "title", "detail", "remediation", "redacted", "key_class")}
    return finding(out, *(["n_lines"] if counted else []), id=identity, category=F.col("category"), severity=F.col("severity"), evidence=evidence, fingerprint=mark, project_url=project, locations=sorted_places(F.col("locations")), **same)
