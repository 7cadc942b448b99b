"""Commits: reachability, budget, changes against the first parent, first and last sight."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Commits up to which one task walks the graph (about 300 bytes each); beyond, the frontier goes by joins.
WALKED = 2_000_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parents: dict[str, list[str]] = {}
    tips: list[str] = []
    for batch in batches:
        for i, up, tip in zip(batch.column("id").to_pylist(), batch.column("parents").to_pylist(), batch.column("tip").to_pylist(), strict=True):
            if i is not None and (i not in parents or up):
                parents[i] = up or []
            if tip:
                tips.append(i)
    seen, left = set(), [t for t in tips if t in parents]
    while left:
        i = left.pop()
        if i not in seen:
            seen.add(i)
            left += [p for p in parents[i] if p in parents and p not in seen]
    found = sorted(seen)
    for k in range(0, len(found), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 10_000], pa.string())], ["id"])


def reachable(commits: DataFrame, tips: DataFrame, checkpoint=None, most_rounds: int = 100_000, walked: int = WALKED) -> DataFrame:
    """The commits(id, parents, ...) that tips(id) reach, each once; parents that are no commits (a shallow history) end a line.

    Up to so many commits, which are counted first, their ids and parents go to one task, which walks them: one job, however long the
    history is. Beyond, the frontier goes back by one join a generation; checkpoint(df) cuts its lineage (by default the
    reliable one of Spark), and a history of more generations than most_rounds is an error.
    """
    ends = tips.select("id").distinct().withColumn("tip", F.lit(True))
    if commits.count() <= walked:
        graph = commits.select("id", "parents").join(ends, "id", "left")
        seen = graph.select("id", "parents", F.coalesce("tip", F.lit(False)).alias("tip")).repartition(1).mapInArrow(_walk, "id string")
        return commits.join(seen, "id", "left_semi")
    cut = checkpoint or (lambda df: df.checkpoint())
    edges = commits.select("id", F.explode_outer("parents").alias("parent")).where("parent IS NOT NULL")
    seen = frontier = cut(commits.select("id").join(ends, "id", "left_semi"))
    for _ in range(most_rounds):
        after = edges.join(frontier, "id", "left_semi").select(F.col("parent").alias("id")).distinct()
        frontier = cut(after.join(commits.select("id"), "id", "left_semi").join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    else:
        raise RuntimeError(f"reachable commits did not end in {most_rounds} generations")
    return commits.join(seen, "id", "left_semi")


def newest(commits: DataFrame, budget: int) -> DataFrame:
    """The newest commits, at most budget, ties by id, both descending."""
    return commits.orderBy(F.col("commit_time").desc(), F.col("id").desc()).limit(budget)


def budgeted(commits: DataFrame, budget: int) -> tuple[DataFrame, bool]:
    """The newest commits, at most budget, and whether there are more."""
    return newest(commits, budget), commits.limit(budget + 1).count() > budget


def walk_warnings(chosen: DataFrame, truncated: bool, budget: int, shallow: bool) -> DataFrame:
    """kind, message of what a walk leaves out: commits past the budget, history that a shallow clone lacks, further parents of merges."""
    said = [("history_budget_hit", f"history scan stopped at budget of {budget} commits")] * truncated + [("shallow_clone", "repository is a shallow clone")] * shallow
    merges = chosen.where(F.size("parents") > 1).select(F.lit("merge_commit_first_parent_only").alias("kind"), F.concat(F.lit("merge commit "), "id", F.lit(" diffed against first parent only")).alias("message"))
    return chosen.sparkSession.createDataFrame(said, "kind string, message string").unionByName(merges)


def changes(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """commit, path, blob_id, mode of entries that the first parent's tree does not have; all of a root's entries.

    commits(id, tree_id, parents); trees(tree_id, path, blob_id, mode). One anti-join on all four columns.
    """
    parent = commits.select(F.col("id").alias("parent"), F.col("tree_id").alias("parent_tree"))
    rows = commits.withColumn("parent", F.get("parents", F.lit(0))).join(parent, "parent", "left").select("id", "tree_id", "parent_tree")
    entries = rows.join(trees, "tree_id").select(F.col("id").alias("commit"), "parent_tree", "path", "blob_id", "mode")
    before = trees.withColumnRenamed("tree_id", "parent_tree")
    return entries.join(before, ["parent_tree", "path", "blob_id", "mode"], "left_anti").drop("parent_tree")


def sightings(rows: DataFrame) -> DataFrame:
    """By path and blob: the number of commits, the first and the last one by time, then id; rows(path, blob_id, sha, commit_time)."""
    at = F.struct("commit_time", "sha")
    return rows.groupBy("path", "blob_id").agg(F.count_distinct("sha").alias("commits"), F.min(at)["sha"].alias("first_sha"), F.max(at)["sha"].alias("last_sha"))


def tree_changes(commits: DataFrame, known: DataFrame, entries: DataFrame, checkpoint) -> DataFrame:
    """What changes() says of commits, from trees that are not flattened: commit, path, blob_id, mode.

    known(id, tree_id) has the parents' trees; entries(tree_id, name, mode, child). Equal subtrees are not entered, so work follows what changed; one round a
    level of folders.
    """
    parent = known.select(F.col("id").alias("parent"), F.col("tree_id").alias("before"))
    level = commits.withColumn("parent", F.get("parents", F.lit(0))).join(parent, "parent", "left").select(F.col("id").alias("commit"), F.lit("").alias("prefix"), "tree_id", "before")
    old = entries.select(F.col("tree_id").alias("before"), "name", F.col("mode").alias("old_mode"), F.col("child").alias("old_child"))
    out = None
    while True:
        both = level.join(entries, "tree_id").join(old, ["before", "name"], "left")
        new = both.where(~(F.col("mode").eqNullSafe(F.col("old_mode")) & F.col("child").eqNullSafe(F.col("old_child"))))
        step = checkpoint(new.select("commit", F.concat("prefix", "name").alias("path"), "mode", "child", F.when(F.col("old_mode") == "40000", F.col("old_child")).alias("before")))
        files = step.where("mode <> '40000'").select("commit", "path", F.col("child").alias("blob_id"), "mode")
        out = files if out is None else out.unionByName(files)
        level = step.where("mode = '40000'").select("commit", F.concat("path", F.lit("/")).alias("prefix"), F.col("child").alias("tree_id"), "before")
        if level.isEmpty():
            return out
