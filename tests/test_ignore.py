from __future__ import annotations

import json

import pytest

from palisade.__main__ import main
from palisade.operators.ignore import ignored_paths, is_ignored

TOKEN = "sb_secret_" + "Ab3dEf6hIj9lMn2pQr5tUv8x"


@pytest.mark.parametrize(
    ("path", "lines", "want"),
    [
        ("a.log", "*.log", True), ("x/a.log", "*.log", True), ("x/a.log", "/*.log", False), ("x/a.log", "*.log\n!a.log", False), ("x/a.log", "x/\n!x/a.log", True), ("x", "x/", False),
        ("x/y/z.ts", "x/**/z.ts", True), ("x/z.ts", "x/**/z.ts", True), ("x/y/z.ts", "x/*.ts", False), ("x/y", "x/**", True), ("a b", "a b  ", True), ("#a", "\\#a", True), ("#a", "#a", False),
        ("a1", "a[0-9]", True), ("ab", "a[!b]", False), ("q/ab", "**/a?", True), ("a.log", "*.log\r", True), ("a", "\n!\n/", False),
    ],
)
def test_lines(path, lines, want):
    assert is_ignored(path, [("", 0, lines)]) is want


def test_deeper_files_come_last(spark):
    rows = [(".gitignore", "*.ts", "working_tree"), ("p/.gitignore", "!a.ts", "working_tree"), ("p/.ignore", "b.js", "working_tree"), ("p/a.ts", "", "commit"), ("p/b.js", "", "working_tree"), ("q/a.ts", "", "commit"), ("b.js", "", "working_tree"), ("q/.gitignore", "!a.ts", "commit")]
    got = ignored_paths(spark.createDataFrame(rows, "path string, content string, prov_kind string"))
    assert sorted(r.path for r in got.collect()) == ["p/b.js", "q/a.ts"]


def test_command(spark, tmp_path, capsys):
    for name, text in ((".gitignore", "hidden/\n.env\n"), ("hidden/a.ts", TOKEN), (".env", f"K={TOKEN[:-1]}y\n"), ("src/a.ts", f"{TOKEN[:-1]}z"), ("lib/a.ts", f"{TOKEN[:-1]}w")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "palisade.toml").write_text('[scan]\nseverity_gate = "critical"\n[ignore]\npaths = ["lib/**"]\n')
    assert main([str(tmp_path), "--format", "json"], spark) == 1
    found = json.loads(capsys.readouterr().out)["findings"]
    assert sorted(x["path"] for f in found for x in f["locations"]) == [".env", "src/a.ts"]
    (tmp_path / "known.json").write_text(json.dumps([f["id"] for f in found]))
    assert main([str(tmp_path), "--baseline", str(tmp_path / "known.json")], spark) == 0
    assert main([str(tmp_path), "--baseline", str(tmp_path / "none.json")], spark) == 2
    (tmp_path / "palisade.toml").write_text('[scan]\nseverity_gate = "loud"\n')
    assert main([str(tmp_path)], spark) == 2
