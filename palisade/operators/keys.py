"""Candidates to findings: keys by what they are, the rest by the kind of their rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.keys import ELEVATED, REMEDIATIONS, TITLES, classified
from palisade.functions.rank import KEY_CLASS_NAMES, mapped
from palisade.functions.text import fingerprint, normalized_url, redact, stable_id
from palisade.operators.detect import spans
from palisade.operators.findings import sorted_places

# What is said of candidates that are no keys.
_TITLE = "Secret candidate matched "
_DETAIL = "The generic detector found a credential-shaped value. Review and rotate the value if it is real."
_REMEDIATION = "Remove the secret from source, rotate it with the provider, and purge committed history if necessary."


def findings_of(candidates: DataFrame) -> DataFrame:
    """Findings of all candidates in one pass over them; raw values end here.

    own_id is what a finding is called before it is merged with others: it decides which of them gives the merged one its texts.
    """
    is_key = F.col("kind") == "possible_supabase_key"
    rows = candidates.withColumn("c", F.when(is_key, classified(F.col("raw"), F.col("hint"))))
    category = F.when(is_key & ~F.col("c.key_class").isin(*ELEVATED), "key_classification").otherwise("secret_exposure")
    severity = F.when(is_key, F.col("c.severity")).otherwise(mapped(F.col("kind"), {"provider_secret": "high", "private_key": "high"}, "medium"))
    confidence = F.when(is_key, F.col("c.confidence")).otherwise(mapped(F.col("kind"), {"provider_secret": "likely", "private_key": "likely"}, "review"))
    group = F.when(is_key, F.concat(F.lit("supabase-key:"), F.col("c.key_class"))).otherwise(F.col("rule_id"))
    title = F.when(is_key, mapped(F.col("c.key_class"), TITLES)).otherwise(F.concat(F.lit(_TITLE), F.col("rule_id")))
    remediation = F.when(is_key, mapped(F.col("c.key_class"), REMEDIATIONS)).otherwise(_REMEDIATION)
    mark, path = fingerprint(F.col("raw")), F.get("locations", F.lit(0))["path"]
    own = F.when(is_key, stable_id("supabase-key", mapped(F.col("c.key_class"), KEY_CLASS_NAMES), mark, path)).otherwise(stable_id("secret", F.col("rule_id"), mark, path))
    return rows.select(
        "content_id", category.alias("category"), severity.alias("severity"), confidence.alias("confidence"), "rule_id", group.alias("rule_or_class"), mark.alias("fingerprint"),
        redact(F.col("raw")).alias("redacted"), "c.key_class", normalized_url(F.col("c.project_url")).alias("project_url"), own.alias("own_id"),
        title.alias("title"), F.when(is_key, F.col("c.detail")).otherwise(_DETAIL).alias("detail"), remediation.alias("remediation"), sorted_places(spans()).alias("locations"),
    )
