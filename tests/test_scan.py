"""The whole scan with recorded answers, its reports, and the command line."""

from __future__ import annotations

import json
import zipfile

import pytest

from palisade.__main__ import DATABASE, main
from palisade.plans.report import FORMATS, history_summary, render
from palisade.plans.scan import Catalog, Probes, Registry, scan

FILES = "path string, content string, prov_kind string, sha string, author string, date string"
URL = "https://abcdefghijklmnopqrst.supabase.co"
PUBLIC = "sb_publishable_" + "AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"
SECRET = "sb_secret_" + "Ab3dEf6hIj9lMn2pQr5tUv8x"
PAGE = f'const url = "{URL}"; const key = "{PUBLIC}";\ndb.from("profiles").select(); db.from("closed").select();\n'
MANIFEST = '{"dependencies": {"evil": "1.0.0", "ghost": "2", "fine": "3", "Bad Name": "1", "@own/x": "1", "odd": "git+https://x"}}'


def _inputs(spark):
    files = spark.createDataFrame([("src/app/page.tsx", PAGE, "working_tree", None, None, None), ("package.json", MANIFEST, "working_tree", None, None, None), ("old.ts", f"{SECRET} {URL}", "commit", "c1", None, "5 +0000"), ("big.ts", "x" * 5000, "working_tree", None, None, None), ("b.bin", "a\0b", "working_tree", None, None, None)], FILES)
    registry = Registry(
        spark.createDataFrame([("npm", "evil", "1.0.0")], "ecosystem string, norm_name string, version string"),
        spark.createDataFrame([("npm", "ghost", 404), ("npm", "fine", 200)], "ecosystem string, norm_name string, status int"),
        unavailable=spark.createDataFrame([("pypi",)], "ecosystem string"),
    )
    read = f"{URL}/rest/v1/%s?select=*&limit=1"
    responses = spark.createDataFrame([(read % "profiles", 200, '[{"a": 1}]', None), (read % "closed", 401, "", None), (read % "listed", 200, "[]", None)], "url string, status int, body string, error string")
    roots = spark.createDataFrame([(URL + "/", 200, '{"paths": {"/listed": {"get": {}}, "/rpc/f": {"get": {}}}}', None)], "project_url string, status int, body string, error string")
    catalog = Catalog(
        URL, spark.createDataFrame([("public", "profiles", True), ("public", "closed", False)], "schema string, name string, rowsecurity boolean"),
        spark.createDataFrame([("public", "profiles", "ALL", True, "(true)", None)], "schema string, name string, command string, permissive boolean, using_expr string, check_expr string"),
        spark.createDataFrame([], "schema string, name string, grantee string, privilege string"),
    )
    return files, registry, Probes(responses, roots), catalog


@pytest.fixture(scope="module")
def found(spark):
    files, registry, probes, catalog = _inputs(spark)
    from dataclasses import replace

    from palisade.functions.rules import DEFAULT

    return scan(files, replace(DEFAULT, max_bytes=4000), registry=registry, probes=probes, catalog=catalog, scope={"target": "<t>", "history": True, "max_commits": 5, "scanned_commits": 1})


def test_findings_of_all_kinds(found):
    rows = found.findings.collect()
    got = sorted((r.category, r.rule_id, r.table or "") for r in rows)
    assert got == [
        ("correlation", "elevated-key-in-tree", ""), ("correlation", "exposed-public-key-chain", "closed"), ("correlation", "exposed-public-key-chain", "profiles"), ("correlation", "exposed-public-key-chain", "profiles"),
        ("dependency_integrity", "invalid_package_name", ""), ("dependency_integrity", "known_malicious", ""), ("dependency_integrity", "nonexistent_package", ""), ("secret_exposure", "supabase-secret-key", ""),
    ]
    assert all(r.title and r.detail and r.remediation and r.evidence for r in rows)
    assert {r.evidence.split(": ")[1] for r in rows if r.rule_id == "exposed-public-key-chain"} == {f"{URL}/rest/v1/profiles?select=*&limit=1 returned 1 row(s) to the public key", "table profiles has permissive USING (true)", "table closed has RLS disabled"}


def test_notes_and_actions(found):
    assert sorted(r.message for r in found.warnings.collect()) == [
        "OSV snapshot unavailable for PyPi", f"Tier 0 RLS read probe key rejected with HTTP 401 at {URL}/rest/v1/closed?select=*&limit=1", "binary file skipped: b.bin", "large file skipped: big.ts (5000 bytes)", "registry check skipped a non-registry dependency source",
    ]
    assert sorted((r.kind, r.table or r.package or "", r.outcome) for r in found.actions.collect()) == [
        ("registry_existence", "fine@3", "registry_resolved"), ("registry_existence", "ghost@2", "not_found"), ("root_enumeration", "", "root_enumerated"), ("table_read", "closed", "key_rejected"), ("table_read", "listed", "no_rows_observed"), ("table_read", "profiles", "exposed"),
    ]
    assert [tuple(r) for r in found.egress.collect()] == [("npm", "registry.npmjs.org")]
    assert [r.name for r in found.dependencies.collect()] == sorted(["evil", "ghost", "fine", "Bad Name", "@own/x", "odd"])
    stats = {r["name"]: r["value"] for r in found.stats.collect()}
    assert (stats["findings"], stats["by_severity.critical"], stats["skipped_large_files"], stats["skipped_binary_files"], stats["scan_budget_hit"], stats["paths_seen"]) == (8, 6, 1, 1, 0, 3)


def test_reports(found):
    texts = {kind: render(found, kind) for kind in FORMATS}
    for text in texts.values():
        assert PUBLIC not in text and SECRET not in text and "known_malicious" in text or "Known-malicious" in text
    data = json.loads(texts["json"])
    assert len(data["findings"]) == 8 and data["scope"]["network"]["enabled"] and data["stats"]["findings"] == 8 and data["scope"]["warnings"]
    assert data["findings"][0]["severity"] == "critical" and [f["id"] for f in data["findings"] if f["category"] == "correlation"] == sorted(f["id"] for f in data["findings"] if f["category"] == "correlation")
    run = json.loads(texts["sarif"])["runs"][0]
    said = run["invocations"][0]["properties"]
    assert said["history"] == "history budgeted 1/5 commits" and said["scanStats"]["dedupRatioPercent"] == "0.00" and said["registryNameEgress"] == ["npm package names sent to registry.npmjs.org"]
    assert len(run["results"]) == len(run["tool"]["driver"]["rules"]) == 8
    (secret,) = [r for r in run["results"] if "secret key" in r["message"]["text"]]
    assert secret["locations"][0] == {"physicalLocation": {"artifactLocation": {"uri": "old.ts"}, "region": {"startLine": 1, "startColumn": 1, "endColumn": 1 + len(SECRET)}}, "properties": {"provenance": "commit c1", "locationClass": "Unknown"}}
    assert "collection: paths 3 | blobs 3 | unique 3 | dedup 0.00% | units 3 | truncated no" in texts["text"] and "  - GET table read for table profiles at" in texts["text"]
    assert "CRITICAL Exposed elevated Supabase key bypasses RLS [correlation]" in texts["text"] and "\x1b[" not in texts["text"] and "\x1b[1;31mCRITICAL\x1b[0m" in render(found, "text", True)
    assert "target: &lt;t&gt;" in texts["html"] and "<span class='sev critical'>CRITICAL</span>: 6" in texts["html"] and "<h2>Warnings</h2>" in texts["html"]
    with pytest.raises(ValueError):
        render(found, "yaml")


def test_history_summaries():
    assert history_summary(False, 5, 0, False) == "history disabled" and history_summary(True, None, 7, False) == "history exhaustive 7 commits"
    assert history_summary(True, 5, 5, True) == "history budgeted 5/5 commits truncated"


def test_nothing_found(spark):
    empty = scan(spark.createDataFrame([("a.ts", "x", "working_tree", None, None, None)], FILES))
    assert "No findings." in render(empty, "text") and "<p>No findings.</p>" in render(empty, "html") and json.loads(render(empty))["findings"] == []


def test_command_with_recorded_answers(spark, tmp_path, capsys, monkeypatch):
    root, recorded = tmp_path / "t", tmp_path / "r"
    (root / "src/app").mkdir(parents=True)
    (recorded / "advisories").mkdir(parents=True)
    (root / "src/app/page.tsx").write_text(PAGE)
    (root / "package.json").write_text(MANIFEST)
    with zipfile.ZipFile(recorded / "advisories/npm.zip", "w") as z:
        z.writestr("a.json", json.dumps({"affected": [{"package": {"ecosystem": "npm", "name": "evil"}, "versions": ["1.0.0"]}]}))
    for name, rows in {
        "answers": [{"ecosystem": "npm", "norm_name": "ghost", "status": 404}], "tables": [{"schema": "public", "name": "profiles", "rowsecurity": False}], "roots": [{"project_url": URL, "status": 403}],
    }.items():
        (recorded / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    args = [str(root), "-f", "json", "--no-history", "--recorded", str(recorded), "--registry-checks", "--rls-tier0-read-probe", "--rls-tier1-introspect"]
    monkeypatch.delenv(DATABASE, raising=False)
    assert main(args, spark) == 2 and DATABASE in capsys.readouterr().err
    monkeypatch.setenv(DATABASE, "postgres://u:p@db.abcdefghijklmnopqrst.supabase.co/x")
    assert main(args, spark) == 1
    data = json.loads(capsys.readouterr().out)
    assert sorted(f["rule_id"] for f in data["findings"]) == ["exposed-public-key-chain", "invalid_package_name", "known_malicious", "nonexistent_package"]
    assert "history scanning disabled" in data["scope"]["warnings"] and any("HTTP 403" in w for w in data["scope"]["warnings"])
    assert main([str(root), "--no-working-tree", "--no-history", "-f", "json"], spark) == 0
    assert main([str(root), "--registry-checks"], spark) == 2
