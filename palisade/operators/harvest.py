"""References to tables in source, and the projects that they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.location import source_scope

_NAME = r"^[A-Za-z0-9_.-]+$"


def references(units: DataFrame) -> DataFrame:
    """content_id, scope, kind, name: calls .from("x") and .rpc("x"), and paths /rest/v1/x; each once."""
    def calls(method: str):
        pattern = rf"(?s)\.{method}\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")"
        return F.concat(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)))

    found = F.concat(
        F.transform(calls("from"), lambda x: F.struct(F.lit("table").alias("kind"), x.alias("name"))),
        F.transform(calls("rpc"), lambda x: F.struct(F.lit("rpc").alias("kind"), x.alias("name"))),
        F.transform(F.regexp_extract_all("content", F.lit(r"/rest/v1/([A-Za-z0-9_.-]+)"), F.lit(1)), lambda x: F.struct(F.lit("table").alias("kind"), x.alias("name"))),
    )
    rows = units.where(F.is_valid_utf8("content")).select("content_id", F.explode(F.array_distinct(found)).alias("r"), F.array_distinct(F.transform("locations", lambda x: source_scope(x["path"]))).alias("scopes"))
    return rows.where(F.trim("r.name").rlike(_NAME)).select("content_id", "r.kind", F.trim("r.name").alias("name"), F.explode("scopes").alias("scope")).distinct()


def associate(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """scope, name, project_url, reason for table references; facts(content_id, scope, project_url) are where projects are named.

    The projects named in the same content decide, if there are any; else those of the same scope. Exactly one is taken;
    otherwise reason says why not.
    """
    known = facts.where("project_url IS NOT NULL")

    def sole(*key: str) -> DataFrame:
        return known.groupBy(*key).agg(F.min("project_url").alias("low"), F.max("project_url").alias("high"))

    by_content = sole("content_id").withColumnsRenamed({"low": "c_low", "high": "c_high"})
    by_scope = sole("scope").withColumnsRenamed({"low": "s_low", "high": "s_high"})
    rows = refs.where("kind = 'table'").join(by_content, "content_id", "left").join(by_scope, "scope", "left")
    low, high = F.coalesce("c_low", "s_low"), F.when(F.col("c_low").isNotNull(), F.col("c_high")).otherwise(F.col("s_high"))
    reason = F.when(low.isNull(), "no associated project").when(low != high, "ambiguous project association")
    return rows.select("scope", "name", F.when(low == high, low).alias("project_url"), reason.alias("reason")).distinct()
