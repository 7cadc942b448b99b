"""Registered queries on commits, their objects and their budget."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from palisade.operators import history
from palisade.plans.inputs import sql
from palisade.plans.queries import _commits
from palisade.plans.registered import query
from palisade.sources.files import text_array
from palisade.sources.git import commits_of, entries_of, peeled

@query(f"""WITH {sql("commits")}, b AS (SELECT id FROM commits ORDER BY commit_time DESC, id DESC LIMIT 300)
SELECT 'history_budget_hit' AS kind, 'history scan stopped at budget of 300 commits' AS message UNION ALL SELECT 'shallow_clone', 'repository is a shallow clone'
 UNION ALL SELECT 'merge_commit_first_parent_only', 'merge commit ' || id || ' diffed against first parent only' FROM b WHERE CAST(substr(id, 2) AS BIGINT) % 40 = 7""")
def walk_warnings(spark, sf_dir):
    """What a walk leaves out: commits past the budget, history that a shallow clone lacks, further parents of merges."""
    commits = _commits(spark, sf_dir)
    merge = F.col("id").substr(2, 20).cast("long") % 40 == 7
    commits = commits.withColumn("parents", F.when(merge, F.concat("parents", F.array(F.lit("c0")))).otherwise(F.col("parents")))
    chosen, truncated = history.budgeted(commits, 300)
    return history.walk_warnings(chosen, truncated, 300, shallow=True)


@query("""SELECT sha1(CAST(event_id AS VARCHAR)) AS id, sha1('t' || event_id) AS tree_id, CAST(event_id % 3 AS INTEGER) AS n_parents, CASE WHEN event_id % 3 > 0 THEN sha1(CAST(event_id - 1 AS VARCHAR)) END AS first_parent,
 'A' || (event_id % 5) || ' <a@b>' AS author, CAST(1000000000 + event_id AS BIGINT) AS commit_time, strftime(to_timestamp(1000000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS date FROM events""")
def commit_objects(spark, sf_dir):
    """Commits as git stores them: tree, parents, author, committer's time; the message is not read."""
    i = F.col("event_id")

    def sha(c):
        return F.sha1(c.cast("string").cast("binary"))

    parents = F.concat(*(F.when(i % 3 > k, F.concat(F.lit("parent "), sha(i - 1 - k), F.lit("\n"))).otherwise("") for k in range(2)))
    people = F.concat(F.lit("author A"), (i % 5).cast("string"), F.lit(" <a@b> 5 +0200\ncommitter C <c@d> "), (i + 1_000_000_000).cast("string"), F.lit(" -0100\n\nparent of all\ntree x\n"))
    body = F.concat(F.lit("tree "), sha(F.concat(F.lit("t"), i.cast("string"))), F.lit("\n"), parents, people).cast("binary")
    found = spark.read.parquet(f"{sf_dir}/events.parquet").select(sha(i).alias("id"), F.lit("commit").alias("kind"), body.alias("body"))
    return commits_of(found).select("id", "tree_id", F.size("parents").alias("n_parents"), F.get("parents", F.lit(0)).alias("first_parent"), "author", "commit_time", "date")


@query("""SELECT md5(CAST(event_id AS VARCHAR)) AS tree_id, n AS name, m AS mode, CASE n WHEN 'a b.ts' THEN sha1('x' || event_id) ELSE sha1('y' || event_id) END AS child FROM events, (VALUES ('a b.ts', '100644'), ('dir', '40000')) AS v(n, m) WHERE event_id % 4 = 0 OR n = 'a b.ts'""")
def tree_objects(spark, sf_dir):
    """Entries of trees as git stores them."""
    i = F.col("event_id")

    def entry(mode: str, name: str, child: str):
        return F.concat(F.lit(f"{mode} {name}\0".encode()), F.unhex(F.sha1(F.concat(F.lit(child), i.cast("string")).cast("binary"))))

    body = F.when(i % 4 == 0, F.concat(entry("100644", "a b.ts", "x"), entry("40000", "dir", "y"))).otherwise(entry("100644", "a b.ts", "x"))
    found = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.md5(i.cast("string").cast("binary")).alias("id"), F.lit("tree").alias("kind"), body.alias("body"))
    return entries_of(found)


@query("""SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN sha1('c' || n_nationkey) ELSE sha1('c' || (n_nationkey - n_nationkey % 3)) END AS id FROM nation""")
def peeled_tips(spark, sf_dir):
    """What refs name, through tags and tags of tags."""
    keys = [r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]
    def name(k: int) -> str:
        return hashlib.sha1(f"{'ctu'[k % 3]}{k}".encode()).hexdigest()

    def at(k: int) -> str:
        return name(k) if k % 3 == 0 else name(k - 1)

    tags = [(name(k), "tag", f"object {at(k)}\ntype x\n".encode()) for k in keys if k % 3]
    return peeled(spark, [name(k) for k in keys], spark.createDataFrame(tags, "id string, kind string, body binary"))


@query("""SELECT n_nationkey, CAST(CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS n, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN lower(n_name) ELSE 'a b' END AS first FROM nation""")
def text_arrays(spark, sf_dir):
    """Text arrays of a database."""
    i, name = F.col("n_nationkey"), F.lower("n_name")
    text = F.when(i % 3 == 0, "{}").when(i % 3 == 1, F.concat(F.lit("{"), name, F.lit(",}"))).otherwise(F.concat(F.lit('{"a b", '), name, F.lit("}")))
    found = text_array(text)
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))
