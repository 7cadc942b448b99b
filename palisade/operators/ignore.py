"""Ignore files: the verdict of all those above a path, by a join on folders.

Lines become patterns once, where the files are; a path meets the patterns of its own ancestors only. As in the tool that
these files come from: the last match wins, deeper files come after higher ones, `!` takes a match back, a trailing slash
means folders, and what lies in an ignored folder stays ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of ignore files; later ones count more in the same folder.
NAMES = (".gitignore", ".ignore", ".palisadeignore")


def pattern(line: str) -> tuple[str, bool, bool] | None:
    """Regular expression of a line, whether it takes matches back, whether it is for folders only; None for no pattern."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder = line.endswith("/")
    line = line.rstrip("/") if folder else line
    if not line:
        return None
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        at_start = i == 0 or line[i - 1] == "/"
        if at_start and line.startswith("**/", i):
            out, i = f"{out}(?:.*/)?", i + 3
        elif at_start and line[i:] == "**":
            out, i = f"{out}.+", i + 2
        elif line[i] == "*":
            out, i = f"{out}[^/]*", i + 1
        elif line[i] == "?":
            out, i = f"{out}[^/]", i + 1
        elif line[i] == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(line, i)):
            out, i = f"{out}(?!/)[{'^' if m[1] else ''}{re.sub(r'([\\\[\]^&~|])', r'\\\1', m[2])}]", m.end()
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    try:
        re.compile(out)
    except re.error:
        return None
    return out, negated, folder


@lru_cache(4096)
def _parsed(content: str) -> tuple:
    return tuple((re.compile(p[0], re.DOTALL), p[1], p[2]) for line in content.split("\n") if (p := pattern(line)))


def is_ignored(path: str, files: list[tuple[str, int, str]]) -> bool:
    """The verdict on a file, from (folder, place in NAMES, content) of the ignore files in its ancestors."""
    files = sorted(files, key=lambda f: (len(f[0]), f[1]), reverse=True)
    ends = [m.start() for m in re.finditer("/", path)] + [len(path)]
    for end in ends:
        verdict = None
        for folder, _, content in files:
            if folder and not path.startswith(f"{folder}/") or len(folder) >= end:
                continue
            name = path[len(folder) + bool(folder) : end]
            verdict = next((not negated for regex, negated, only in reversed(_parsed(content)) if not (only and end == len(path)) and regex.fullmatch(name)), None)
            if verdict is not None:
                break
        if verdict:
            return True
    return False


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        keep = [r["path"] for r in rows if is_ignored(r["path"], [(x["folder"], x["place"], x["content"]) for x in r["above"]])]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["path"])


#: Bytes of ignore files up to which they are sent to all tasks as they are.
SENT_BYTES = 32 << 20


def _judge_with(found: list[tuple[str, int, str]]):
    by_folder: dict[str, list[tuple[str, int, str]]] = {}
    for row in found:
        by_folder.setdefault(row[0], []).append(row)

    def above(path: str) -> list[tuple[str, int, str]]:
        ends = [0, *(m.start() for m in re.finditer("/", path))]
        return [row for e in ends for row in by_folder.get(path[:e], ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for p in batch.column("path").to_pylist() if is_ignored(p, above(p))], pa.string())], ["path"])

    return run


def ignored_paths(files: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The distinct paths of files(path, content, prov_kind) that the ignore files of the working tree leave out.

    The ignore files are few and small, as a rule: up to so many bytes of them, which are counted first, go to every task. Beyond, each is
    joined to the paths below its folder.
    """
    name, folder = F.regexp_extract("path", "[^/]*$", 0), F.regexp_replace("path", "/?[^/]*$", "")
    own = files.where((F.col("prov_kind") == "working_tree") & name.isin(*NAMES) & F.is_valid_utf8("content"))
    rules = own.select(folder.alias("folder"), (F.array_position(F.array(*map(F.lit, NAMES)), name) - 1).cast("int").alias("place"), "content").distinct()
    paths = files.select("path").where("path IS NOT NULL").distinct()
    size = rules.agg(F.sum(F.octet_length("content") + F.octet_length("folder"))).first()[0] or 0
    if size <= sent_bytes:
        return paths.mapInArrow(_judge_with([tuple(r) for r in rules.collect()]), "path string")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = paths.select("path", F.explode(folders).alias("folder")).join(rules, "folder")
    return above.groupBy("path").agg(F.collect_list(F.struct("folder", "place", "content")).alias("above")).mapInArrow(_judge, "path string")
