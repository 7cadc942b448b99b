from __future__ import annotations

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.location import location_class
from palisade.functions.text import entropy, lines, redact
from palisade.operators.coalesce import coalesced
from palisade.operators.dependencies import dependencies, structural
from palisade.operators.detect import detect
from palisade.operators.history import reachable
from palisade.operators.keys import findings_of
from palisade.operators.units import collect_units, scannable, should_scan
from palisade.plans.report import FORMATS, render
from palisade.plans.scan import scan
from palisade.plans.shared import checkpointed

FILES = "path string, content string, prov_kind string, sha string, author string, date string"
TOKEN = "sb_secret_" + "Ab3dEf6hIj9lMn2pQr5tUv8x"


def files(spark, *rows):
    return spark.createDataFrame([(p, c, "commit" if s else "working_tree", s, None, None) for p, c, s in rows], FILES)


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        (".env.local", "", "server_only"), ("src/app/api/x.ts", "", "server_only"), ("packages/web/src/api/a.ts", "x", "client_reachable"),
        ("packages/web/src/api/a.ts", 'import x from "node:fs"', "server_only"), ("src/api/a.ts", "'use server'", "server_only"), ("apps/api/x.ts", "", "server_only"),
        ("src/App/page.tsx", "", "client_reachable"), ("lib/a.client.ts", "", "client_reachable"), ("lib/a.ts", "", "unknown"), ("apps/web/.next/static/a.js", "", "client_reachable"),
        ("supabase/functions/a.ts", "", "server_only"), ("dist/a.js", "", "client_reachable"), ("src/components/a.tsx", "", "client_reachable"), ("myserver/a.ts", "", "unknown"),
    ],
)
def test_location_class(spark, path, content, want):
    got = spark.createDataFrame([(path, content)], "p string, c string").select(location_class(F.col("p"), F.col("c"))).first()[0]
    assert got == want


def test_lines_and_columns(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("x\n\n",)], "t string")
    assert [r[0] for r in df.select(lines(F.col("t"))).collect()] == [["a", "b"], [], ["x", ""]]
    df = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("é",)], "t string")
    assert [r[0] for r in df.select(entropy(F.col("t"))).collect()] == [0.0, 0.0, 1.0, 1.0]
    assert [r[0] for r in spark.createDataFrame([("a" * 12,), ("abcdefghijklm",)], "t string").select(redact(F.col("t"))).collect()] == ["***", "abcdef...jklm"]


def test_paths(spark):
    want = {".env": True, "a/.env.prod": True, ".env.example": False, "node_modules/x/a.js": False, "a/b.pyc": False, "dist/a.js": True, "target/x": False, "a/target/x": True, "src/a.ts": True}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert dict(df.select("p", should_scan(F.col("p"))).collect()) == want


def test_detect_places_and_allowlists(spark):
    text = f"ok\n😀 key={TOKEN} and {TOKEN}\nsb_secret_exampleexampleexampleexample\n{TOKEN} palisade:allow\n"
    units = collect_units(files(spark, ("a.ts", text, None), ("vendor/a.ts", text, None)))
    got = detect(units).orderBy("line_no", "col_start").collect()
    assert [(r.rule_id, r.line_no, r.col_start, r.col_end) for r in got] == [("supabase-secret-key", 2, 7, 41), ("supabase-secret-key", 2, 46, 80)]
    assert all([x.path for x in r.locations] == ["a.ts"] for r in got)


def test_overlapping_rules_and_minified_lines(spark):
    token = "sk-ant-api03-" + "aB3xK9zQw7" * 4
    units = collect_units(files(spark, ("a.ts", f"{token}\npassword = '{'aB3x' * 8}'{' ' * 500}\n", None)))
    assert sorted(r.rule_id for r in detect(units).collect()) == ["anthropic-api-key", "openai-api-key"]


def test_projects_are_reconciled(spark):
    one = files(spark, ("a.ts", f"{TOKEN} https://p1.supabase.co", None), ("b.ts", TOKEN, None))
    two = files(spark, ("a.ts", f"{TOKEN} https://p1.supabase.co", None), ("b.ts", TOKEN, None), ("c.ts", f"{TOKEN} https://p2.supabase.co", None))

    def found(f):
        return sorted((r.project_url or "", len(r.locations)) for r in coalesced(findings_of(detect(collect_units(f)))).collect())

    assert found(one) == [("https://p1.supabase.co", 2)]
    assert found(two) == [("", 1), ("https://p1.supabase.co", 1), ("https://p2.supabase.co", 1)]
    assert found(two.repartition(5).orderBy(F.rand(3))) == found(two)


def test_nothing_raw_is_reported(spark):
    s = scan(files(spark, ("src/app/a.ts", f"{TOKEN} https://p1.supabase.co\n" + "token = '" + "aB3xK9z_" * 4 + "'", None), ("package.json", '{"dependencies": {"Bad Name": "", "ok": "1"}}', None)))
    for kind in FORMATS:
        text = render(s, kind)
        assert TOKEN not in text and "aB3xK9z_" * 4 not in text
    assert {f["category"] for f in json.loads(render(s))["findings"]} == {"secret_exposure", "dependency_integrity"}


def test_binary_and_large_files_are_left_out(spark):
    df = files(spark, ("a.ts", "x\0y", None), ("b.ts", "y" * 20, None), ("c.ts", "z", None))
    assert [r.path for r in scannable(df, 10).collect()] == ["c.ts"]


def test_manifests(spark):
    rows = [
        ("package.json", '{"dependencies": {"a": "1", "B": {"version": " "}}}'), ("package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/b": {"version": "2"}}, "dependencies": {"x": "1"}}'),
        ("x/requirements.txt", "a-b[c]>=1 # x\n-r y\ngit+https://z\n_bad==1\n"), ("pyproject.toml", '[project]\ndependencies = ["q>=1"]\n[tool.poetry.dependencies]\npython = "3"\nr = "2"\n'),
        ("poetry.lock", '[[package]]\nname = "s"\nversion = "1"\n'), ("node_modules/package.json", "{}"), ("bad/package.json", "{"),
    ]
    deps = dependencies(spark.createDataFrame(rows, "path string, content string"))
    got = {(r.path, r.name, r.version_req) for r in deps.where("error IS NULL").collect()}
    assert got == {("package.json", "a", "1"), ("package.json", "B", " "), ("package-lock.json", "a", "1"), ("x/requirements.txt", "a-b", "[c]>=1"), ("x/requirements.txt", "_bad", "==1"), ("pyproject.toml", "q", ">=1"), ("pyproject.toml", "r", "2"), ("poetry.lock", "s", "1")}
    assert deps.where("error IS NOT NULL").count() == 1
    assert sorted((r.name, r.reason) for r in structural(deps.where("error IS NULL")).collect()) == [("B", "empty_version_specifier"), ("B", "invalid_package_name"), ("_bad", "invalid_package_name")]


def test_custom_rules(spark):
    more = rules.load("[[rules]]\nid = 'mine'\nregex = '(zz[0-9]{4})'\n")
    assert [r.rule_id for r in detect(collect_units(files(spark, ("a.ts", "zz1234", None))), more).collect()] == ["mine"]
    for bad in ("[[rules]]\nid = 'stripe-secret-key'\nregex = 'x'\n", "[[rules]]\nid = 'b'\nregex = '(?=x)'\n", "[[rules]]\nid = 'b'\nregex = '('\n", "["):
        with pytest.raises(rules.RuleError):
            rules.load(bad)


def test_checkpoints_leave_no_shuffle_files(spark):
    def shuffled() -> set[str]:
        names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {x for x in names if re.search(r"/shuffle_\d+_", x)}

    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(freed, None)
    before, rows = shuffled(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = checkpointed(rows)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(freed, None) == setting
    assert out.count() == rows.count() == 7 and rows.collect() and checkpointed(rows.join(out, "k")).count() == 7


def test_reachability(spark):
    commits = spark.createDataFrame([("a", ["b", "x"]), ("b", ["c"]), ("c", []), ("d", ["c"]), ("e", ["gone"])], "id string, parents array<string>")
    tips = spark.createDataFrame([("a",), ("e",), ("none",)], "id string")
    for walked in (0, 100):
        assert sorted(r.id for r in reachable(commits, tips, checkpointed, 4, walked).collect()) == ["a", "b", "c", "e"]
    with pytest.raises(RuntimeError):
        reachable(commits, tips, checkpointed, 1, 0)


def test_long_history_is_one_walk(spark):
    n = 20_000
    commits = spark.range(n).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("c"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    assert reachable(commits, spark.createDataFrame([(f"c{n - 2}",)], "id string")).count() == n - 1
