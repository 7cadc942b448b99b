"""python -m palisade TARGET: scans a working tree and its history, and prints a report. Exit code 0: clean, 1: the gate is met, 2: an error."""

from __future__ import annotations

import argparse
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.rank import SEVERITIES
from palisade.operators.correlate import gate
from palisade.operators.databases import target
from palisade.plans import config
from palisade.plans.report import FORMATS, render
from palisade.plans.scan import Catalog, Probes, Registry, scan
from palisade.sources.files import advisories, baseline, working_tree
from palisade.sources.git import git_folder, history

#: Where the address of a database is read from; it names the project whose recorded catalog is used.
DATABASE = "PALISADE_DB_URL"
_RECORDED = {
    "responses": "url string, status int, body string, error string",
    "roots": "project_url string, status int, body string, error string",
    "answers": "ecosystem string, norm_name string, status int",
    "tables": "schema string, name string, rowsecurity boolean",
    "policies": "schema string, name string, command string, permissive boolean, using_expr string, check_expr string",
    "grants": "schema string, name string, grantee string, privilege string",
    "cache": "key string, fetched_at long, exists boolean",
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palisade", description="Finds exposed credentials in a working tree and its history.")
    p.add_argument("target", nargs="?", default=".")
    p.add_argument("-f", "--format", choices=FORMATS, default="text")
    for name in ("history", "working-tree"):
        either = p.add_mutually_exclusive_group()
        either.add_argument(f"--{name}", action="store_true", default=None)
        either.add_argument(f"--no-{name}", dest=name.replace("-", "_"), action="store_false")
    most = p.add_mutually_exclusive_group()
    most.add_argument("--max-commits", type=int)
    most.add_argument("--exhaustive-history", action="store_true")
    p.add_argument("--max-bytes", type=int)
    p.add_argument("--baseline")
    p.add_argument("--severity-gate", choices=tuple(SEVERITIES))
    p.add_argument("--color", action="store_true")
    p.add_argument("--recorded", help="folder with recorded answers as JSON lines; nothing is asked over a network")
    p.add_argument("--rls-tier0-read-probe", action="store_true", help="use the recorded answers of reads with public keys")
    p.add_argument("--rls-tier1-introspect", action="store_true", help=f"use the recorded catalog of the project that {DATABASE} names")
    p.add_argument("--registry-checks", action="store_true", help="use the recorded answers of registries and advisory archives")
    return p


def _recorded(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    if not folder:
        raise ValueError("recorded answers are needed: name their folder with --recorded")
    path = os.path.join(folder, f"{name}.json")
    return spark.read.schema(_RECORDED[name]).json(path) if os.path.exists(path) else spark.createDataFrame([], _RECORDED[name])


def _inputs(spark: SparkSession, given: argparse.Namespace) -> dict:
    out: dict = {}
    folder = given.recorded and os.path.abspath(given.recorded)
    if given.rls_tier0_read_probe:
        out["probes"] = Probes(_recorded(spark, folder, "responses"), _recorded(spark, folder, "roots"))
    if given.rls_tier1_introspect:
        address = os.environ.get(DATABASE)
        if not address:
            raise ValueError(f"introspection needs {DATABASE}")
        out["catalog"] = Catalog(target(address).project_url, *(_recorded(spark, folder, n) for n in ("tables", "policies", "grants")))
    if given.registry_checks:
        answers, cache = _recorded(spark, folder, "answers"), _recorded(spark, folder, "cache")
        archives = os.path.join(folder, "advisories")
        known = advisories(spark, archives) if os.path.isdir(archives) else spark.createDataFrame([], "ecosystem string, norm_name string, version string")
        missing = answers.select("ecosystem").distinct().join(known.select("ecosystem").distinct(), "ecosystem", "left_anti")
        out["registry"] = Registry(known, answers, cache, int(time.time()), missing, dict(os.environ))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = _parser().parse_args(args)
    try:
        root = os.path.abspath(given.target)
        if not os.path.isdir(root):
            raise FileNotFoundError(f"no folder {root}")
        named = {k: getattr(given, k) for k in ("history", "working_tree", "max_commits", "max_bytes", "baseline", "severity_gate")}
        settings = replace(config.load(root), **{k: v for k, v in named.items() if v is not None})
        if given.exhaustive_history:
            settings = replace(settings, max_commits=None)
        for name in (settings.baseline, settings.rules):
            if name and not os.path.exists(name):
                raise FileNotFoundError(f"no file {name}")
        ruleset = rules.DEFAULT
        if settings.rules:
            with open(settings.rules, encoding="utf-8") as f:
                ruleset = rules.load(f.read())
        ruleset = replace(ruleset, max_bytes=settings.max_bytes)
        spark = spark or SparkSession.builder.appName("palisade").getOrCreate()
        known = baseline(spark, os.path.abspath(settings.baseline)) if settings.baseline else None
        files = working_tree(spark, root, settings.max_bytes)
        if not settings.working_tree:
            files = files.where(F.lit(False))
        git = git_folder(root) if settings.history else None
        scope = {"target": given.target, "working_tree": settings.working_tree, "history": git is not None, "max_commits": settings.max_commits}
        warnings = spark.createDataFrame([] if settings.history else [("other", "history scanning disabled")], "kind string, message string")
        if git:
            past = history(spark, git, settings.max_commits, settings.max_bytes)
            files, warnings = files.unionByName(past.files), warnings.unionByName(past.warnings)
            scope |= {"scanned_commits": past.scanned, "truncated": past.truncated}
        found = scan(files, ruleset, known, settings.ignore_paths, warnings=warnings, scope=scope, **_inputs(spark, given))
        sys.stdout.write(render(found, given.format, given.color))
        return gate(found.findings, settings.severity_gate).first()[0]
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
