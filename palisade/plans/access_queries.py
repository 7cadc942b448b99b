"""Registered queries on access rules: inputs of probes, recorded answers, texts, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import rls
from palisade.operators.findings import best_place
from palisade.plans.inputs import frame, sql
from palisade.plans.queries import _introspected, _RLS
from palisade.plans.registered import query
from palisade.plans.report import action_summary

_PROBED = """r AS (SELECT project_url, p.table AS tbl, regexp_replace(project_url, '/+$', '') || '/rest/v1/' || p.table || '?select=*&limit=1' AS endpoint, status, body, error FROM probed p LEFT JOIN responses ON url = regexp_replace(project_url, '/+$', '') || '/rest/v1/' || p.table || '?select=*&limit=1'),
o AS (SELECT *, CASE WHEN error IS NOT NULL OR status IS NULL THEN 'transport_error' WHEN status = 401 THEN 'key_rejected' WHEN status = 403 THEN 'protected' WHEN status = 404 THEN 'not_found' WHEN status <> 200 OR NOT starts_with(body, '[') THEN 'invalid_response' WHEN body = '[]' THEN 'no_rows_observed' ELSE 'exposed' END AS outcome FROM r),
pr AS (SELECT *, CASE WHEN outcome IN ('exposed', 'no_rows_observed') THEN len(body) - len(replace(body, '{', '')) END AS observed_rows FROM o)"""
_ROOTS = """answers AS (SELECT 'https://Proj-' || n_nationkey || '.supabase.co/' AS project_url, CAST(CASE n_nationkey % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS INT) AS status, CASE n_nationkey % 6 WHEN 3 THEN 'no json' ELSE '{"paths":{}}' END AS body, CASE WHEN n_nationkey % 6 = 4 THEN 'timeout' END AS error FROM nation),
ro AS (SELECT lower(regexp_replace(project_url, '/+$', '')) AS project_url, lower(regexp_replace(project_url, '/+$', '')) || '/rest/v1/' AS endpoint, CASE WHEN error IS NULL THEN status END AS status,
 CASE WHEN error IS NOT NULL THEN 'transport_error' WHEN status = 200 AND body <> 'no json' THEN 'root_enumerated' WHEN status IN (401, 403) THEN 'root_unavailable' ELSE 'invalid_response' END AS outcome,
 CASE WHEN error IS NOT NULL THEN error WHEN status IN (401, 403) THEN 'root enumeration unavailable: HTTP ' || status WHEN status <> 200 THEN 'OpenAPI root returned HTTP ' || status WHEN body = 'no json' THEN 'invalid OpenAPI document' END AS cause FROM answers)"""


def _probes(spark, sf_dir):
    return rls.probe(frame(spark, sf_dir, "probed"), frame(spark, sf_dir, "responses"))


def _roots(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*_expressions(_ROOTS))
    return rls.root_outcomes(rows.select("project_url"), rows)


def _expressions(text: str) -> list[str]:
    inner = text[text.index("(SELECT ") + 8 : text.index(" FROM nation)")]
    url, _, rest = inner.partition(" AS project_url, ")
    status, _, rest = rest.partition(" AS status, ")
    body, _, error = rest.partition(" AS body, ")
    return [f"{url} AS project_url", f"{status} AS status", f"{body} AS body", error]


@query(f"WITH {_ROOTS} SELECT * FROM ro")
def root_answers(spark, sf_dir):
    """Recorded answers to requests for API descriptions."""
    return _roots(spark, sf_dir)


_LAST = """CASE WHEN outcome = 'transport_error' THEN 'no answer' WHEN outcome = 'invalid_response' AND status <> 200 THEN 'table probe returned HTTP ' || status WHEN outcome = 'invalid_response' THEN 'invalid body' END"""


@query(f"""WITH {sql("probed")}, {sql("responses")}, {_PROBED}, {_ROOTS},
t AS (SELECT *, {_LAST} AS failed FROM pr),
a AS (SELECT CASE WHEN outcome = 'key_rejected' THEN 'key-rejected' ELSE 'transport:' || failed END AS cause, endpoint AS url, CASE WHEN outcome = 'key_rejected' THEN 'Tier 0 RLS read probe key rejected with HTTP 401 at ' || endpoint ELSE 'Tier 0 RLS read probe transport/other error at ' || endpoint || ': ' || failed END AS message FROM t WHERE outcome = 'key_rejected' OR failed IS NOT NULL
 UNION ALL SELECT CASE WHEN outcome = 'root_unavailable' THEN 'root-enumeration-unavailable:' || status ELSE 'transport:' || cause END, endpoint, CASE WHEN outcome = 'root_unavailable' THEN 'Tier 0 RLS read probe root enumeration unavailable with public key at ' || endpoint || ' (HTTP ' || status || '); continuing with LocalStatic candidates' ELSE 'Tier 0 RLS read probe transport/other error at ' || endpoint || ': ' || cause END FROM ro WHERE cause IS NOT NULL
 UNION ALL SELECT 'no-candidate-tables:' || project_url, project_url, 'Tier 0 RLS read probe found no candidate tables for ' || project_url || '; nothing to probe' FROM ro WHERE outcome = 'root_unavailable')
SELECT cause, min(url) AS url, arg_min(message, url) AS message FROM a GROUP BY cause""")
def probe_causes(spark, sf_dir):
    """Warnings of probes, one for each cause."""
    roots = _roots(spark, sf_dir)
    bare = roots.where("outcome = 'root_unavailable'").select("project_url", F.array().cast("array<string>").alias("tables"))
    return rls.probe_warnings(_probes(spark, sf_dir), roots, bare)


@query(f"""WITH {sql("probed")}, {sql("responses")}, {_PROBED}, {_ROOTS}, x AS (SELECT 'TABLE' AS k, endpoint, tbl, status, outcome, observed_rows FROM pr UNION SELECT 'ROOT', endpoint, NULL, status, outcome, NULL FROM ro)
SELECT CASE k WHEN 'TABLE' THEN 'GET table read for table ' || tbl ELSE 'GET root enumeration' END || ' at ' || endpoint || ' -> ' || replace(outcome, '_', ' ') || coalesce('; HTTP ' || status, '') || coalesce('; observed ' || observed_rows || ' row(s)', '') AS summary FROM x""")
def network_actions(spark, sf_dir):
    """One line for each recorded answer that was looked up."""
    rows = rls.probe_actions(_probes(spark, sf_dir), _roots(spark, sf_dir))
    return rows.select(action_summary(*(F.col(c) for c in ("kind", "intent", "endpoint", "table", "package", "status", "outcome", "observed_rows"))).alias("summary"))


@query(f"""WITH {sql("probed")}, {sql("responses")}, {_PROBED} SELECT 'rls-' || substr(sha256(project_url || chr(0) || tbl || chr(0) || endpoint), 1, 24) AS id, endpoint || ' returned ' || observed_rows || ' row(s) to the public key' AS reproduction,
 'Exposed table ' || tbl || ' on ' || project_url || ' via ' || endpoint || '; observed ' || observed_rows || ' row(s)' AS evidence, CASE WHEN contains(project_url, 'proj-1.') THEN 'k.ts' END AS path FROM pr WHERE outcome = 'exposed'""")
def probe_findings(spark, sf_dir):
    """Findings of probes, at the place of the project's key."""
    place = F.expr("named_struct('path', 'k.ts', 'line', 1, 'col_start', 1, 'col_end', 9, 'prov_kind', 'working_tree', 'sha', cast(null as string), 'shas', array(''), 'location_class', 'unknown')")
    inputs = spark.range(1).select(F.lit("https://proj-1.supabase.co").alias("project_url"), place.alias("key_place"))
    return rls.probe_findings(_probes(spark, sf_dir), inputs).select("id", "reproduction", "evidence", F.get("locations", F.lit(0))["path"].alias("path"))


_KEYED = """kp AS (SELECT event_id, 'https://P' || (event_id % 7) || '.supabase.co' || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END AS project_url, CASE event_id % 3 WHEN 0 THEN 'publishable_new' WHEN 1 THEN 'anon_legacy' ELSE 'secret_new' END AS key_class,
 'f' || (event_id % 23) || '.ts' AS path, CAST(event_id % 5 AS INT) AS line, CASE event_id % 4 WHEN 0 THEN 'client_reachable' WHEN 1 THEN 'server_only' ELSE 'unknown' END AS cl FROM events)"""


@query(f"""WITH {_KEYED}, x AS (SELECT lower(regexp_replace(project_url, '/+$', '')) AS project_url, path, CASE cl WHEN 'client_reachable' THEN 2 WHEN 'server_only' THEN 1 ELSE 0 END AS r, cl FROM kp WHERE key_class <> 'secret_new'),
b AS (SELECT DISTINCT project_url, first_value(path) OVER (PARTITION BY project_url ORDER BY r DESC, path) AS path, first_value(cl) OVER (PARTITION BY project_url ORDER BY r DESC, path) AS cl FROM x)
SELECT project_url, path, cl AS location_class, CASE project_url WHEN 'https://p3.supabase.co' THEN 'a,b' WHEN 'https://p5.supabase.co' THEN 'c' ELSE '' END AS tables FROM b""")
def probe_inputs(spark, sf_dir):
    """The best place of a public key, and the harvested tables, of each project."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_keyed())
    none = F.lit(None).cast("string")
    place = F.struct("path", F.col("line").alias("line"), F.lit(1).alias("col_start"), F.lit(2).alias("col_end"), F.lit("working_tree").alias("prov_kind"), none.alias("sha"), F.array().cast("array<string>").alias("shas"), F.col("cl").alias("location_class"))
    worse = F.struct(F.lit("a.ts").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("col_start"), F.lit(2).alias("col_end"), F.lit("working_tree").alias("prov_kind"), none.alias("sha"), F.array().cast("array<string>").alias("shas"), F.lit("unknown").alias("location_class"))
    places = F.when(F.col("cl") == "unknown", F.array(place)).otherwise(F.array(worse, place))
    tables = spark.createDataFrame([("https://p3.supabase.co/", "b"), ("https://P3.supabase.co", "a"), ("https://p5.supabase.co", "c"), ("https://p99.supabase.co", "z")], "project_url string, table string")
    out = rls.probe_inputs(rows.select("key_class", "project_url", places.alias("locations")), tables)
    return out.select("project_url", "key_place.path", "key_place.location_class", F.array_join("tables", ",").alias("tables"))


def _keyed() -> list[str]:
    inner = _KEYED[_KEYED.index("(SELECT ") + 8 : _KEYED.index(" FROM events)")]
    url, _, rest = inner.removeprefix("event_id, ").partition(" AS project_url, ")
    key, _, rest = rest.partition(" AS key_class,")
    path, _, rest = rest.partition(" AS path, ")
    line, _, cl = rest.partition(" AS line, ")
    return ["event_id", f"{url} AS project_url", f"{key} AS key_class", f"{path.strip()} AS path", f"{line} AS line", cl]


@query(f"WITH {_KEYED}, x AS (SELECT event_id % 97 AS g, path, line, CASE cl WHEN 'client_reachable' THEN 2 WHEN 'server_only' THEN 1 ELSE 0 END AS r FROM kp) SELECT DISTINCT g, first_value(path) OVER w AS path, first_value(line) OVER w AS line FROM x WINDOW w AS (PARTITION BY g ORDER BY r DESC, path, line)")
def best_places(spark, sf_dir):
    """Of several places the one of the highest class, then of the smallest path and span."""
    none = F.lit(None).cast("string")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_keyed())
    place = F.struct("path", "line", F.lit(1).alias("col_start"), F.lit(2).alias("col_end"), F.lit("working_tree").alias("prov_kind"), none.alias("sha"), F.array().cast("array<string>").alias("shas"), F.col("cl").alias("location_class"))
    grouped = rows.groupBy((F.col("event_id") % 97).alias("g")).agg(F.collect_list(place).alias("places"))
    return grouped.select("g", best_place(F.col("places")).alias("x")).select("g", "x.path", "x.line")


@query(f"""WITH {_RLS} SELECT id, CASE exposure WHEN 'rls_disabled' THEN 'Supabase table ' || tbl || ' has RLS disabled' WHEN 'permissive_policy' THEN 'Supabase table ' || tbl || ' has a literal-true ' || command || ' policy' WHEN 'missing_operation_policy' THEN 'Supabase table ' || tbl || ' has no ' || command || ' policy'
 ELSE 'Supabase table ' || tbl || ' has inferred ' || command || ' exposure for ' || (SELECT max(x) FROM rl WHERE rl.url = rf.url AND rl.tbl = rf.tbl AND rl.command = rf.command AND rl.exposure = rf.exposure AND 'rls-policy-' || substr(sha256(nm || chr(0) || rl.url || chr(0) || rl.tbl || chr(0) || rl.command || chr(0) || x), 1, 24) = rf.id) END AS title,
 CASE exposure WHEN 'rls_disabled' THEN 'table ' || tbl || ' has RLS disabled' WHEN 'permissive_policy' THEN 'table ' || tbl || ' has permissive USING (true)' END AS reproduction FROM rf""")
def policy_texts(spark, sf_dir):
    """What is said of the catalog's findings, and which of them prove that a table can be read."""
    return rls.policy_findings(_introspected(spark, sf_dir)).select("id", "title", "reproduction")


@query("""SELECT n_nationkey, n_nationkey % 4 = 0 AS ok, n_nationkey % 3 <> 0 AS literal FROM nation""")
def guards(spark, sf_dir):
    """Addresses of projects that may be probed, and predicates that are literally true in any number of parentheses."""
    i = F.col("n_nationkey")
    url = F.when(i % 4 == 0, "https://ab-9.supabase.co//").when(i % 4 == 1, "http://ab.supabase.co").when(i % 4 == 2, "https://ab.supabase.co/x").otherwise("https://ab.supabase.co.evil.org")
    deep = F.concat(F.repeat(F.lit("( "), i.cast("int")), F.lit("TRUE"), F.repeat(F.lit(" )"), i.cast("int")))
    text = F.when(i % 3 != 0, deep).otherwise(F.concat(deep, F.lit(")")))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", rls.project_ok(url).alias("ok"), rls.literal_true(text).alias("literal"))
