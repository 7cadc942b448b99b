"""Classes of locations: monorepos, segments and not parts of names, flat repositories, what a source shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.location import location_class

FETCH = "export const load = () => fetch('/rest/v1/profiles');"
CASES = {
    "client_reachable": [
        ("apps/web/.next/static/chunks/x.js", ""), ("packages/ui/src/components/Btn.tsx", ""), ("packages/web/src/api/client.ts", FETCH), ("apps/web/app/page.tsx", ""), ("apps/web/app/foo/api/route.ts", ""),
        ("public/config.js", ""), ("app/page.tsx", ""), ("pages/index.tsx", ""), ("src/app/page.tsx", ""), ("src/pages/index.tsx", ""), ("src/components/Button.tsx", ""), ("src/client/widget.ts", ""), ("src/Button.client.tsx", ""),
        ("dist/bundle.js", ""), ("build/assets/app.js", ""), (".next/static/chunks/x.js", ""), ("src/api/supabase.ts", FETCH), ("src/api/env-client.ts", "const url = process.env.NEXT_PUBLIC_SUPABASE_URL;"),
        ("src/api/node-label.ts", "const runtime = 'node:fs';"), ("src/api/helper.ts", "const runtime = myrequire('node:fs');"),
    ],
    "server_only": [
        ("apps/api/.env", ""), ("apps/web/.env.local", ""), ("services/api/index.ts", ""), ("services/api/src/api/handler.ts", 'import { NextRequest } from "next/server";'), ("apps/web/app/api/route.ts", ""),
        ("apps/web/.next/server/vendor-chunks/x.js", ""), (".env", ""), (".env.local", ""), ("server/index.ts", ""), ("supabase/functions/ping/index.ts", ""), ("api/handler.ts", ""), ("apps/api/index.ts", "export const client = true;"),
        ("src/api/handler.ts", 'import { NextRequest } from "next/server";'), ("src/api/db.ts", 'import "node:fs";'), ("src/api/actions.ts", "'use server';"), ("src/api/require-db.ts", "const crypto = require('node:crypto');"),
    ],
    "unknown": [("staticassets/x.js", ""), ("apps/web/src/myenv.ts", ""), ("apps/foo/api-docs/readme.md", ""), ("src/lib/util.ts", "")],
}


def test_classes(spark):
    rows = [(p, c, want) for want, cases in CASES.items() for p, c in cases]
    assert len(rows) == 40
    got = spark.createDataFrame(rows, "path string, content string, want string").withColumn("got", location_class(F.col("path"), F.col("content"))).where("got <> want").collect()
    assert got == []


def test_long_quoted_texts(spark):
    text = "x = '" + "a\\'" * 20_000 + "'; import \"node:fs\""
    assert spark.createDataFrame([(text,)], "c string").select(location_class(F.lit("src/api/a.ts"), F.col("c"))).first()[0] == "server_only"
