"""Git folders, written by the git program and read without it."""

from __future__ import annotations

import json
import shutil
import subprocess

import pytest

from palisade.__main__ import main
from palisade.sources import git as g

TOKEN = "sb_secret_" + "Ab3dEf6hIj9lMn2pQr5tUv8x"


def _git(root, *args, time=0):
    when = f"{1_700_000_000 + time} +0200"
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "PATH": "/usr/bin:/bin", "HOME": str(root), "GIT_CONFIG_NOSYSTEM": "1"}
    return subprocess.run(["git", *args], cwd=root, env=env, check=True, capture_output=True, text=True).stdout


@pytest.fixture
def repository(tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git program")
    _git(tmp_path, "init", "-q", "-b", "main")
    long = [f"line {i} of the text" for i in range(2000)]
    for k in range(6):
        (tmp_path / "a/b").mkdir(parents=True, exist_ok=True)
        (tmp_path / "a/b/long.txt").write_text("\n".join([*long[: 300 * k], f"edit {k}", *long[300 * k :]]))
        (tmp_path / "a/same.txt").write_text("always the same")
        (tmp_path / "top.ts").write_text(f"const k = '{TOKEN}'\n" if k == 2 else f"nothing {k}\n")
        if k == 4:
            (tmp_path / "a/same.txt").rename(tmp_path / "moved.txt")
        _git(tmp_path, "add", "-A", time=k)
        _git(tmp_path, "commit", "-q", "-m", f"c{k}", time=k)
        if k == 3:
            _git(tmp_path, "tag", "-a", "v1", "-m", "tag", time=k)
            _git(tmp_path, "tag", "-a", "v2", "v1", "-m", "tag of a tag", time=k)
            _git(tmp_path, "checkout", "-q", "--detach")
    _git(tmp_path, "update-ref", "-d", "refs/heads/main")
    return tmp_path


def _listed(root):
    out = set()
    for commit in _git(root, "rev-list", "--all", "HEAD").split():
        lines = _git(root, "diff-tree", "-r", "--root", "--no-commit-id", "--no-renames", "--diff-filter=AM", commit).splitlines()
        out |= {(commit, x.split("\t")[1], _git(root, "cat-file", "blob", x.split()[3])) for x in lines}
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_history_equals_git(spark, repository, packed):
    if packed:
        _git(repository, "gc", "-q", "--aggressive")
        assert list((repository / ".git/objects/pack").glob("*.pack"))
    rows = g.history_files(spark, g.git_folder(str(repository / "a"))).collect()
    assert len(rows) == len(set(rows)) and {(r.sha, r.path, r.content) for r in rows} == _listed(repository)
    assert {(r.author, r.prov_kind) for r in rows} == {("A <a@b>", "commit")} and min(r.date for r in rows) == "2023-11-14T22:13:20Z"
    newest = g.history_files(spark, str(repository / ".git"), budget=1).collect()
    assert {r.sha for r in newest} == {_git(repository, "rev-parse", "HEAD").strip()}


def test_deltas_by_id_and_bad_packs(repository):
    ids = _git(repository, "rev-list", "--objects", "--all", "HEAD").split("\n")
    named = "".join(x.split(" ")[0] + "\n" for x in ids if x)
    data = subprocess.run(["git", "pack-objects", "--stdout", "-q", "--window=50"], cwd=repository, input=named.encode(), capture_output=True, check=True).stdout
    pack = g.Pack(data)
    assert any(kind == g.BY_ID for kind, *_ in pack.places.values())
    assert {i for i, _, _ in pack.objects()} == {x.split(" ")[0] for x in ids if x}
    for bad in (b"PICK", data[:200]):
        with pytest.raises((ValueError, IndexError)):
            g.Pack(bad)


def test_command_reads_history(spark, repository, capsys):
    assert main([str(repository), "--format", "json"], spark) == 1
    places = [x for f in json.loads(capsys.readouterr().out)["findings"] for x in f["locations"]]
    assert [x["path"] for x in places] == ["top.ts"] and places[0]["prov_kind"] == "commit"
    assert main([str(repository), "--format", "json", "--no-history"], spark) == 0
    assert json.loads(capsys.readouterr().out)["findings"] == []
