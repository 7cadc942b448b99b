from __future__ import annotations

import json
import zipfile

from palisade.operators.detect import detect
from palisade.operators.units import collect_units
from palisade.sources.files import advisories, baseline, snapshots, text_array, working_tree
from palisade.streaming.detect import stream_findings, write

TOKEN = "sb_secret_" + "Ab3dEf6hIj9lMn2pQr5tUv8x"


def test_working_tree_and_baseline(spark, tmp_path):
    (tmp_path / "t/src").mkdir(parents=True)
    (tmp_path / "t/src/a.ts").write_text(TOKEN)
    (tmp_path / "t/b.bin").write_bytes(b"\xff\xfe")
    tree = working_tree(spark, str(tmp_path / "t"))
    assert [(r.path, r.content) for r in tree.where("is_valid_utf8(content)").collect()] == [("src/a.ts", TOKEN)]
    assert collect_units(tree).select("content_id").count() == 2 and detect(collect_units(tree)).count() == 1
    (tmp_path / "b.json").write_text('["x", "y"]')
    (tmp_path / "r.json").write_text(json.dumps({"findings": [{"id": "z"}], "stats": {}}))
    assert sorted(r.id for r in baseline(spark, str(tmp_path / "b.json")).collect()) == ["x", "y"]
    assert [r.id for r in baseline(spark, str(tmp_path / "r.json")).collect()] == ["z"]


def test_advisories(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.json", json.dumps({"affected": [{"package": {"ecosystem": "PyPI", "name": "A_b"}, "versions": ["1", "2"]}]}))
        z.writestr("readme.txt", "x")
    got = sorted(map(tuple, advisories(spark, str(tmp_path / "s.zip")).collect()))
    assert got == [("pypi", "a-b", "1"), ("pypi", "a-b", "2")]
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "half.zip", "w") as z:
        z.writestr("a.json", json.dumps({"affected": [{"package": {"ecosystem": "npm", "name": "x"}, "versions": ["1"]}]}))
        z.writestr("b.json", "{")
    rows = snapshots(spark, f"{tmp_path}/*.zip").collect()
    assert sorted((r.name, r.error) for r in rows if r.error) == [("bad.zip", "BadZipFile"), ("half.zip", "JSONDecodeError")]
    assert sorted(map(tuple, advisories(spark, f"{tmp_path}/*.zip").collect())) == got


def test_text_array(spark):
    df = spark.createDataFrame([('{anon,"a b",}',), ("{}",)], "t string")
    assert [r[0] for r in df.select(text_array(df.t)).collect()] == [["anon", "a b"], []]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.ts", f"x\n{TOKEN}\n")], "path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    write(stream_findings(files), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.path, r.rule_id, r.line_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.ts", "supabase-secret-key", 2)]
