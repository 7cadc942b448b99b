"""Inputs of the registered queries, derived from the driver's tables by expressions that Spark and DuckDB read alike.

Keys and tokens are made from hashes; none is real.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession


def _token(role: str, ref: str, issuer: str = "supabase") -> str:
    def part(x: dict) -> str:
        return base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")

    return f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'iss': issuer, 'ref': ref, 'role': role})}.c2lnbmF0dXJlLW9mLW5vdGhpbmc"


#: role and project of the tokens planted, by number.
TOKENS = [("anon", "proj-0"), ("service_role", "proj-1"), ("other", "proj-2"), ("anon", "proj-3")]

_PATH = """CASE doc_id % 12 WHEN 0 THEN 'src/app/page' || doc_id || '.tsx' WHEN 1 THEN 'apps/web' || (doc_id % 3) || '/src/api/client' || doc_id || '.ts' WHEN 2 THEN 'server/s' || doc_id || '.ts'
 WHEN 3 THEN '.env.local' || (doc_id % 50) WHEN 4 THEN 'packages/p' || (doc_id % 5) || '/lib/x' || doc_id || '.ts' WHEN 5 THEN 'supabase/functions/f' || doc_id || '.ts' WHEN 6 THEN 'public/a' || doc_id || '.js'
 WHEN 7 THEN 'services/s1/api/r' || doc_id || '.ts' WHEN 8 THEN 'node_modules/m/' || doc_id || '.js' WHEN 9 THEN 'dist/b' || doc_id || '.js' WHEN 10 THEN 'docs/d' || doc_id || '.md' ELSE 'notes/n' || doc_id || '.example' END"""
_LINE = f"""CASE doc_id % 7 WHEN 0 THEN 'const key = "sb_publishable_' || md5(CAST(doc_id % 40 AS STRING)) || '"; // https://proj-' || (doc_id % 5) || '.supabase.co' WHEN 1 THEN 'sb_secret_' || md5(CAST(doc_id % 30 AS STRING)) || ' https://proj-1.supabase.co/x'
 WHEN 2 THEN 'supabase ' || CASE doc_id % 4 {" ".join(f"WHEN {i} THEN '{_token(*t)}'" for i, t in enumerate(TOKENS))} END WHEN 3 THEN 'token = "' || md5(CAST(doc_id % 20 AS STRING)) || '"'
 WHEN 4 THEN 'stripe sk_live_' || md5(CAST(doc_id AS STRING)) || ' example' WHEN 5 THEN 'aws AKIA' || upper(substr(md5(CAST(doc_id AS STRING)), 1, 16)) ELSE 'import x from "next/server"; db.from("t' || (doc_id % 9) || '").select(); db.rpc("f"); fetch("/rest/v1/r' || (doc_id % 4) || '?a")' END"""

#: name: (table, expressions).
INPUTS = {
    "files": ("documents", ["doc_id", f"{_PATH} AS path", f"coalesce(text, '') || chr(10) || ({_LINE}) AS content", "CASE WHEN doc_id % 3 = 0 THEN 'commit' ELSE 'working_tree' END AS prov_kind", "CASE WHEN doc_id % 3 = 0 THEN substr(md5(CAST(doc_id % 17 AS STRING)), 1, 12) END AS sha", "CAST(NULL AS STRING) AS author", "CAST(NULL AS STRING) AS date"]),
    "keys": ("documents", ["doc_id", f"CASE doc_id % 4 WHEN 0 THEN 'sb_publishable_' || md5(CAST(doc_id AS STRING)) WHEN 1 THEN 'sb_secret_' || md5(CAST(doc_id AS STRING)) WHEN 2 THEN CASE doc_id % 5 {' '.join(f'''WHEN {i} THEN '{_token(*t)}' ''' for i, t in enumerate(TOKENS))} ELSE '{_token('anon', 'proj-9', 'elsewhere')}' END ELSE 'eyJ' || md5(CAST(doc_id AS STRING)) || '.x.y' END AS raw", "CASE WHEN doc_id % 3 = 0 THEN 'https://proj-' || (doc_id % 5) || '.supabase.co' END AS hint"]),
    "candidates": ("nation", ["'https://proj-' || (n_nationkey % 5) || '.supabase.co/' AS project_url", "CASE WHEN n_nationkey % 4 = 0 THEN 'private.' || lower(n_name) ELSE lower(n_name) END AS candidate"]),
    "tables": ("nation", ["CASE WHEN n_nationkey % 4 = 0 THEN 'private' WHEN n_nationkey % 7 = 0 THEN 'other' ELSE 'public' END AS schema", "lower(n_name) AS name", "n_nationkey % 3 <> 0 AS rowsecurity"]),
    "policies": ("nation", ["CASE WHEN n_nationkey % 4 = 0 THEN 'private' WHEN n_nationkey % 7 = 0 THEN 'other' ELSE 'public' END AS schema", "lower(n_name) AS name", "CASE n_nationkey % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'select' WHEN 2 THEN 'INSERT ' ELSE 'UPDATE' END AS command", "n_nationkey % 2 = 0 AS permissive", "CASE WHEN n_nationkey % 6 < 3 THEN '((TRUE ))' WHEN n_nationkey % 6 = 3 THEN '(true) OR (false)' ELSE 'auth.uid() = owner' END AS using_expr"]),
    "grants": ("nation", ["CASE WHEN n_nationkey % 4 = 0 THEN 'private' WHEN n_nationkey % 7 = 0 THEN 'other' ELSE 'public' END AS schema", "lower(n_name) AS name", "CASE n_nationkey % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'Anon' ELSE 'authenticated' END AS grantee", "CASE n_nationkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'insert' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS privilege"]),
    "probed": ("nation", ["'https://proj-' || (n_nationkey % 5) || '.supabase.co/' AS project_url", "lower(n_name) AS table"]),
    "responses": ("nation", ["'https://proj-' || (n_nationkey % 5) || '.supabase.co/rest/v1/' || lower(n_name) || '?select=*&limit=1' AS url", "CAST(CASE n_nationkey % 8 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 200 END AS INT) AS status", "CASE n_nationkey % 8 WHEN 4 THEN '[]' WHEN 5 THEN '{\"a\":1}' WHEN 6 THEN '[{\"a\":1},{\"a\":2}]' ELSE '[{\"a\":1}]' END AS body", "CASE WHEN n_nationkey = 24 THEN 'timeout' END AS error"]),
    "roots": ("nation", ["'https://proj-' || n_nationkey || '.supabase.co' AS project_url", "'{\"paths\":{\"/\":{\"get\":{}},\"/' || lower(n_name) || '\":{\"get\":{}},\"/w' || n_nationkey || '\":{\"post\":{}},\"/rpc/f\":{\"get\":{}},\"/t' || (n_nationkey % 3) || '\":{\"get\":{},\"post\":{}}}}' AS body"]),
    "deps": ("part", ["'m/' || (p_partkey % 50) || '/package.json' AS path", "CASE p_partkey % 2 WHEN 0 THEN 'dependencies' ELSE 'devDependencies' END AS section", "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN '@scope/' || lower(substr(md5(p_name), 1, 8)) WHEN 3 THEN 'sk_live_' || substr(md5(p_name), 1, 6) ELSE 'pkg-' || (p_partkey % 90) END AS name", "CASE p_partkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'git+https://x' WHEN 2 THEN '^1.' || p_size ELSE '1.' || p_size END AS version_req", "true AS has_version", "CASE WHEN p_partkey % 6 = 5 THEN 'pypi' ELSE 'npm' END AS ecosystem", "p_partkey % 6 = 2 AS is_scoped", "true AS check", "CAST(NULL AS STRING) AS error"]),
    "advisories": ("part", ["CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem", "'pkg-' || (p_partkey % 90) AS norm_name", "'1.' || (p_partkey % 11) AS version"]),
    "resolutions": ("part", ["CASE WHEN p_partkey % 6 = 5 THEN 'pypi' ELSE 'npm' END AS ecosystem", "'pkg-' || (p_partkey % 90) AS norm_name", "(p_partkey % 90) % 4 <> 0 AS exists", "CASE WHEN (p_partkey % 90) % 9 = 1 THEN 'timeout' END AS error"]),
    "commits": ("events", ["'c' || event_id AS id", "'t' || event_id AS tree_id", "CASE WHEN event_id % 10 = 0 THEN '' ELSE 'c' || (event_id - 1) END AS parent", "event_id // 3 AS commit_time"]),
    "trees": ("events", ["event_id", "'t' || event_id AS tree_id", "event_type AS path", "CAST(user_id % 7 AS STRING) AS blob_id", "'100644' AS mode"]),
}
INPUTS["commits"][1][-1] = "CAST(floor(event_id / 3) AS BIGINT) AS commit_time"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions = INPUTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*expressions)


def sql(name: str) -> str:
    """The same input as a common table expression."""
    table, expressions = INPUTS[name]
    return f"{name} AS (SELECT {', '.join(expressions)} FROM {table})"
