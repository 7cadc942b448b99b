"""Access rules of tables: recorded probe responses, and catalog facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.keys import PUBLIC
from palisade.functions.rank import EXPOSURE_NAMES, location_rank, mapped
from palisade.functions.text import normalized_url, stable_id
from palisade.operators.findings import best_place, finding

COMMANDS, WRITES = ("SELECT", "INSERT", "UPDATE", "DELETE"), ("INSERT", "UPDATE", "DELETE")


def literal_true(expression: Column) -> Column:
    """Whether an expression is true in balanced outer parentheses, however many: nothing but true inside, as many to open as to close."""
    opened, closed = (F.length(expression) - F.length(F.replace(expression, F.lit(p), F.lit(""))) for p in "()")
    return F.coalesce(expression.rlike(r"(?i)^[\s(]*true[\s)]*\z") & (opened == closed), F.lit(False))


# What is said of each exposure.
_TITLES = {
    "rls_disabled": "Supabase table {table} has RLS disabled",
    "permissive_policy": "Supabase table {table} has a literal-true {command} policy",
    "missing_operation_policy": "Supabase table {table} has no {command} policy",
    "inferred_write_exposure": "Supabase table {table} has inferred {command} exposure for {who}",
}
_DETAILS = {
    "rls_disabled": "Credentialed Tier 1 catalog introspection confirmed that row-level security is disabled for this API-exposed table.",
    "permissive_policy": "Credentialed Tier 1 catalog introspection confirmed a permissive policy whose USING predicate is the literal true, so that policy does not restrict the operation.",
    "missing_operation_policy": "Row-level security is enabled and other policies exist, but no policy covers {command}: the operation is denied by default where no permissive policy applies.",
    "inferred_write_exposure": "Write exposure is inferred from the {who} role's {command} grant plus the absence of a policy covering {command}; no write was attempted.",
}
_REMEDIATIONS = {
    "rls_disabled": "Enable row-level security and add least-privilege policies for every intended API operation.",
    "permissive_policy": "Replace the literal-true predicate with a least-privilege condition tied to the authenticated subject and intended rows.",
    "missing_operation_policy": "Add an explicit least-privilege {command} policy if the operation is intended, or document and test that the default denial is required.",
    "inferred_write_exposure": "Revoke the {command} grant from {who} unless it is required, and add a least-privilege {command} policy before enabling the operation.",
}


def _said(templates: dict[str, str], **values: Column) -> Column:
    """The template of the exposure, with its places filled in."""
    out = mapped(F.col("exposure"), templates)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return out


def _policy_row(rows: DataFrame, exposure: str, severity: str, command: Column, identity: Column) -> DataFrame:
    url = F.regexp_replace("project_url", "/+$", "")
    using, check = (F.col(c) if c in rows.columns and exposure == "permissive_policy" else F.lit(None).cast("string") for c in ("using_expr", "check_expr"))
    return rows.select(
        "project_url", "table", command.alias("command"), F.lit(exposure).alias("exposure"), F.lit(severity).alias("severity"), identity.alias("who"), using.alias("using_expr"), check.alias("check_expr"),
        stable_id("rls-policy", F.lit(EXPOSURE_NAMES[exposure]), url, F.col("table"), command, identity).alias("id"),
    )


def policy_findings(rows: DataFrame) -> DataFrame:
    """introspect() rows in the form of findings."""
    table, command = F.col("table"), F.col("command")
    words = {"table": table, "command": command, "who": F.col("who")}
    security = F.when(F.col("exposure") == "rls_disabled", "disabled").otherwise("enabled")
    none = F.lit("<none>")
    shown = F.concat(mapped(F.col("exposure"), EXPOSURE_NAMES), F.lit(" table "), table, F.lit(" on "), F.col("project_url"), F.lit("; command "), command, F.lit("; rowsecurity "), security, F.lit("; USING "), F.coalesce("using_expr", none), F.lit("; WITH CHECK "), F.coalesce("check_expr", none))
    proof = F.when(F.col("exposure") == "rls_disabled", F.concat(F.lit("table "), table, F.lit(" has RLS disabled"))).when(F.col("exposure") == "permissive_policy", F.concat(F.lit("table "), table, F.lit(" has permissive USING (true)")))
    said = {"title": _said(_TITLES, **words), "detail": _said(_DETAILS, **words), "remediation": _said(_REMEDIATIONS, **words)}
    return finding(rows, id=F.col("id"), category=F.lit("rls"), severity=F.col("severity"), confidence=F.lit("confirmed"), rule_id=F.col("exposure"), evidence=shown, project_url=F.col("project_url"), table=table, exposure=F.col("exposure"), reproduction=proof, **said)


def matched_tables(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """candidates(project_url, candidate) with the catalog tables(schema, name, rowsecurity) that they mean.

    A bare name matches any schema, a dotted one both parts: two equi-joins, not one with OR. table is the name to report.
    """
    dotted = F.contains("candidate", F.lit("."))
    bare = candidates.where(~dotted).join(tables, F.col("candidate") == F.col("name"))
    full = candidates.where(dotted).withColumns({"c_schema": F.substring_index("candidate", ".", 1), "c_name": F.regexp_replace("candidate", r"^[^.]*\.", "")})
    full = full.join(tables, (F.col("c_schema") == F.col("schema")) & (F.col("c_name") == F.col("name"))).drop("c_schema", "c_name")
    reported = F.when(dotted | (F.col("schema") == "public"), F.col("candidate")).otherwise(F.concat_ws(".", "schema", "name"))
    return bare.unionByName(full).withColumn("table", reported)


def introspect(candidates: DataFrame, tables: DataFrame, policies: DataFrame, grants: DataFrame) -> DataFrame:
    """id, project_url, table, command, exposure, severity, who, using_expr, check_expr of what the catalog shows.

    policies(schema, name, command, permissive, using_expr, and check_expr if known), grants(schema, name, grantee, privilege). Without row security
    that is all there is to say about a table. Else: permissive policies that are literally true; commands that no policy
    covers, if there is any policy; write grants to API roles that no policy covers.
    """
    found = matched_tables(candidates, tables)
    nothing = F.lit("")
    off = _policy_row(found.where(~F.col("rowsecurity")), "rls_disabled", "critical", F.lit("ALL"), nothing)
    on = found.where("rowsecurity").select("project_url", "table", "schema", "name")
    held = on.join(policies, ["schema", "name"])
    command = F.upper(F.trim("command"))
    open_ = _policy_row(held.where(F.col("permissive") & literal_true(F.col("using_expr"))), "permissive_policy", "critical", command, command)
    covered = held.groupBy("project_url", "table").agg(F.collect_set(command).alias("commands"))
    missing = covered.where(~F.array_contains("commands", "ALL")).select("project_url", "table", F.explode(F.array_except(F.array(*map(F.lit, COMMANDS)), "commands")).alias("missing"))
    missing = _policy_row(missing, "missing_operation_policy", "medium", F.col("missing"), nothing)
    granted = on.join(grants, ["schema", "name"]).where(F.lower(F.trim("grantee")).isin("anon", "authenticated") & F.upper("privilege").isin(*WRITES))
    uncovered = granted.join(covered, ["project_url", "table"], "left").where(F.col("commands").isNull() | ~(F.array_contains("commands", "ALL") | F.array_contains("commands", F.upper(F.trim("privilege")))))
    write = _policy_row(uncovered, "inferred_write_exposure", "high", F.upper(F.trim("privilege")), F.lower(F.trim("grantee")))
    return off.unionByName(open_).unionByName(missing).unionByName(write).groupBy("id").agg(F.min(F.struct("project_url", "table", "command", "exposure", "severity", "who", "using_expr", "check_expr")).alias("x")).select("id", "x.*")


def openapi_tables(roots: DataFrame) -> DataFrame:
    """project_url, table of the recorded API descriptions roots(project_url, body): /name paths that can be read."""
    paths = F.from_json(F.get_json_object("body", "$.paths"), "map<string,map<string,string>>")
    rows = roots.select("project_url", F.explode(F.map_entries(paths)).alias("e"))
    return rows.where(F.col("e.key").rlike("^/[^/]+$") & F.map_contains_key("e.value", "get")).select("project_url", F.substring("e.key", 2, 1 << 20).alias("table")).distinct()


def candidate_tables(harvested: DataFrame, described: DataFrame) -> DataFrame:
    return harvested.select("project_url", "table").union(described.select("project_url", "table")).distinct()


def probe_inputs(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """project_url, key_place, tables: for each project with a public key, the best place of one and the tables harvested for it.

    keys are findings of keys; tables(project_url, table). Of several keys that of the highest class of place counts, then of the
    smallest path. Projects without a table have an empty array.
    """
    known = keys.where(F.col("key_class").isin(*PUBLIC) & F.col("project_url").isNotNull()).select(normalized_url(F.col("project_url")).alias("project_url"), best_place(F.col("locations")).alias("key_place"))
    order = F.struct(-location_rank(F.col("key_place.location_class")), F.col("key_place.path"))
    best = known.groupBy("project_url").agg(F.min_by("key_place", order).alias("key_place"))
    named = tables.groupBy(normalized_url(F.col("project_url")).alias("project_url")).agg(F.array_sort(F.collect_set("table")).alias("tables"))
    return best.join(named, "project_url", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))


def project_ok(url: Column) -> Column:
    """Whether a project address is https, a host only, of the domain, with a valid name."""
    return F.regexp_replace(url, "/+$", "").rlike(r"^https://[a-z0-9-]+\.supabase\.co\z")


def root_outcomes(projects: DataFrame, roots: DataFrame) -> DataFrame:
    """project_url, endpoint, status, outcome, cause of the recorded answers roots(project_url, status, body, error) of API descriptions."""
    url = normalized_url(F.col("project_url"))
    answers = roots.select(url.alias("project"), "status", "body", "error").groupBy("project").agg(F.min(F.struct("status", "body", "error")).alias("a")).select("project", "a.*")
    rows = projects.select(url.alias("project")).distinct().join(answers, "project", "left")
    readable = F.try_parse_json("body").isNotNull()
    failed = F.col("error").isNotNull() | F.col("status").isNull()
    outcome = F.when(failed, "transport_error").when((F.col("status") == 200) & readable, "root_enumerated").when(F.col("status").isin(401, 403), "root_unavailable").otherwise("invalid_response")
    endpoint = F.concat("project", F.lit("/rest/v1/"))
    cause = F.when(failed, F.coalesce("error", F.lit("no answer"))).when(F.col("outcome") == "root_unavailable", F.concat(F.lit("root enumeration unavailable: HTTP "), F.col("status").cast("string"))).when((F.col("outcome") == "invalid_response") & (F.col("status") != 200), F.concat(F.lit("OpenAPI root returned HTTP "), F.col("status").cast("string"))).when(F.col("outcome") == "invalid_response", "invalid OpenAPI document")
    return rows.withColumn("outcome", outcome).select(F.col("project").alias("project_url"), endpoint.alias("endpoint"), F.when(~failed, F.col("status")).alias("status"), "outcome", cause.alias("cause"))


def probe(tables: DataFrame, responses: DataFrame) -> DataFrame:
    """project_url, table, endpoint, status, outcome, observed_rows, id (of the finding, where rows were returned).

    tables(project_url, table); responses(url, status, body, error) are recorded: nothing is requested. Row contents are
    counted and dropped.
    """
    endpoint = F.concat(F.regexp_replace("project_url", "/+$", ""), F.lit("/rest/v1/"), F.col("table"), F.lit("?select=*&limit=1"))
    rows = tables.withColumn("endpoint", endpoint).join(responses, F.col("endpoint") == F.col("url"), "left")
    body = F.try_parse_json("body")
    n = F.when(F.schema_of_variant(body).startswith("ARRAY"), F.json_array_length("body"))
    outcome = (
        F.when(F.col("url").isNull() | F.col("error").isNotNull(), "transport_error")
        .when(F.col("status") == 401, "key_rejected").when(F.col("status") == 403, "protected").when(F.col("status") == 404, "not_found")
        .when((F.col("status") != 200) | n.isNull(), "invalid_response").when(n > 0, "exposed").otherwise("no_rows_observed")
    )
    out = rows.select("project_url", "table", "endpoint", "status", outcome.alias("outcome"), F.when((F.col("status") == 200) & F.col("error").isNull(), n).cast("long").alias("observed_rows"))
    return out.withColumn("id", F.when(F.col("outcome") == "exposed", stable_id("rls", F.col("project_url"), F.col("table"), F.col("endpoint"))))


def probe_findings(probes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Probes that returned rows, in the form of findings, at the place of the project's key; inputs as probe_inputs() gives them."""
    at = inputs.select(F.col("project_url").alias("project"), "key_place")
    rows = probes.where("outcome = 'exposed'").withColumn("project", normalized_url(F.col("project_url"))).join(at, "project", "left")
    n, table, endpoint = F.col("observed_rows").cast("string"), F.col("table"), F.col("endpoint")
    proof = F.concat(endpoint, F.lit(" returned "), n, F.lit(" row(s) to the public key"))
    shown = F.concat(F.lit("Exposed table "), table, F.lit(" on "), F.col("project_url"), F.lit(" via "), endpoint, F.lit("; observed "), n, F.lit(" row(s)"))
    return finding(
        rows, id=F.col("id"), category=F.lit("rls"), severity=F.lit("critical"), confidence=F.lit("confirmed"), rule_id=F.lit("exposed"), evidence=shown, project_url=F.col("project_url"), table=table, exposure=F.lit("exposed"), reproduction=proof,
        title=F.concat(F.lit("Supabase table "), table, F.lit(" is readable with the public key")),
        detail=F.lit("A read-only Tier 0 probe confirmed that PostgREST returned rows to the discovered public Supabase key."),
        remediation=F.lit("Enable and tighten RLS policies for this table, then rerun the read probe to confirm anonymous reads no longer return rows."),
        locations=F.when(F.col("key_place").isNotNull(), F.array("key_place")).otherwise(F.array()),
    )


def probe_actions(probes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each answer that was looked up: kind, intent, endpoint, table, package, status, outcome, observed_rows; each once."""
    none = F.lit(None).cast("string")
    reads = probes.select(F.lit("table_read").alias("kind"), F.lit("get").alias("intent"), "endpoint", "table", none.alias("package"), F.col("status").cast("int").alias("status"), "outcome", "observed_rows")
    listed = roots.select(F.lit("root_enumeration").alias("kind"), F.lit("get").alias("intent"), "endpoint", none.alias("table"), none.alias("package"), F.col("status").cast("int").alias("status"), "outcome", F.lit(None).cast("long").alias("observed_rows"))
    return reads.unionByName(listed).distinct()


def probe_warnings(probes: DataFrame, roots: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """cause, url, message: one warning for each cause; roots as root_outcomes() gives them, inputs with all tables that are to be probed."""
    status = F.col("status").cast("string")
    failed = F.when(F.col("outcome") == "transport_error", "no answer").when((F.col("outcome") == "invalid_response") & (F.col("status") != 200), F.concat(F.lit("table probe returned HTTP "), status)).when(F.col("outcome") == "invalid_response", "invalid body")
    cause = F.when(F.col("outcome") == "key_rejected", F.lit("key-rejected")).otherwise(F.concat(F.lit("transport:"), failed))
    rejected = F.concat(F.lit("Tier 0 RLS read probe key rejected with HTTP 401 at "), F.col("endpoint"))
    other = F.concat(F.lit("Tier 0 RLS read probe transport/other error at "), F.col("endpoint"), F.lit(": "))
    rows = probes.select(cause.alias("cause"), F.col("endpoint").alias("url"), F.when(F.col("outcome") == "key_rejected", rejected).otherwise(F.concat(other, failed)).alias("message"))
    if roots is not None:
        closed = F.concat(F.lit("Tier 0 RLS read probe root enumeration unavailable with public key at "), F.col("endpoint"), F.lit(" (HTTP "), status, F.lit("); continuing with LocalStatic candidates"))
        shut = F.col("outcome") == "root_unavailable"
        rows = rows.unionByName(roots.select(F.when(shut, F.concat(F.lit("root-enumeration-unavailable:"), status)).otherwise(F.concat(F.lit("transport:"), F.col("cause"))).alias("cause"), F.col("endpoint").alias("url"), F.when(shut, closed).otherwise(F.concat(other, F.col("cause"))).alias("message")))
    if inputs is not None:
        none = inputs.where(F.size("tables") == 0).select(F.concat(F.lit("no-candidate-tables:"), F.col("project_url")).alias("cause"), F.col("project_url").alias("url"), F.concat(F.lit("Tier 0 RLS read probe found no candidate tables for "), F.col("project_url"), F.lit("; nothing to probe")).alias("message"))
        rows = rows.unionByName(none)
    return rows.where("cause IS NOT NULL").groupBy("cause").agg(F.min(F.struct("url", "message")).alias("w")).select("cause", "w.*")
