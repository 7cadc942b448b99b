"""The form of findings: their columns, places, and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.rank import location_rank

PLACE = "path string, line int, col_start int, col_end int, prov_kind string, sha string, shas array<string>, location_class string"
PLACES = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in PLACE.split(', '))}>>"
#: Columns of findings, with their types.
FIELDS = {
    "id": "string",
    "category": "string",
    "severity": "string",
    "confidence": "string",
    "rule_id": "string",
    "title": "string",
    "detail": "string",
    "remediation": "string",
    "evidence": "string",
    "fingerprint": "string",
    "redacted": "string",
    "key_class": "string",
    "project_url": "string",
    "locations": PLACES,
    "table": "string",
    "exposure": "string",
    "reproduction": "string",
    "related": "array<string>",
}
_EMPTY = {"locations", "related"}


def finding(rows: DataFrame, *more: str, **given: Column) -> DataFrame:
    """rows in the form of findings: the columns given, and nulls or empty arrays for the others; then columns of rows that are named."""

    def column(name: str, kind: str) -> Column:
        c = given.get(name)
        if c is None:
            c = F.array() if name in _EMPTY else F.lit(None)
        return c.cast(kind).alias(name)

    return rows.select(*(column(n, k) for n, k in FIELDS.items()), *more)


def place(path: Column, location_class: str) -> Column:
    """A place in the working tree without line and column."""
    none = F.lit(None)
    return F.struct(path.alias("path"), none.cast("int").alias("line"), none.cast("int").alias("col_start"), none.cast("int").alias("col_end"), F.lit("working_tree").alias("prov_kind"), none.cast("string").alias("sha"), F.array().cast("array<string>").alias("shas"), F.lit(location_class).alias("location_class"))


def sorted_places(places: Column) -> Column:
    """Places by path, span (none first), provenance and rank of their class; each once."""
    keyed = F.transform(places, lambda x: F.struct(x["path"].alias("a"), x["line"].alias("b"), x["col_start"].alias("c"), x["col_end"].alias("d"), x["prov_kind"].alias("e"), x["sha"].alias("f"), location_rank(x["location_class"]).alias("g"), x.alias("x")))
    return F.array_distinct(F.transform(F.array_sort(keyed), lambda k: k["x"]))


def best_place(places: Column) -> Column:
    """The place of the highest class; of those the one of the smallest path, then of the smallest span."""
    keyed = F.transform(places, lambda x: F.struct((-location_rank(x["location_class"])).alias("a"), x["path"].alias("b"), x["line"].alias("c"), x["col_start"].alias("d"), x["col_end"].alias("e"), x.alias("x")))
    return F.array_min(keyed)["x"]


def key_evidence(class_name: Column, redacted: Column, project: Column, fingerprint: Column) -> Column:
    return F.concat(class_name, F.lit(" "), redacted, F.lit(" on "), F.coalesce(project, F.lit("unknown project")), F.lit(" fingerprint "), fingerprint)


def secret_evidence(redacted: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("secret "), redacted, F.lit(" fingerprint "), fingerprint)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 12)


def commit_time(date: Column) -> Column:
    """The first word of a date as a number; 0 if it is none."""
    return F.coalesce(F.get(F.split(F.trim(date), r"\s+"), F.lit(0)).try_cast("long"), F.lit(0).cast("long"))


def provenance_summary(kind: Column, sha: Column) -> Column:
    return F.when(kind == "commit", F.concat(F.lit("commit "), F.coalesce(sha, F.lit("")))).otherwise("working tree")


def location_summary(x: Column) -> Column:
    """One line about a place: path, span, provenance, class, and of several commits the first and the last one listed."""
    span = F.when(x["line"].isNotNull(), F.concat(F.lit(":"), x["line"].cast("string"), F.lit(":"), x["col_start"].cast("string"), F.lit("-"), x["col_end"].cast("string"))).otherwise("")
    commits = F.filter(x["shas"], lambda s: s != "")
    seen = F.concat(F.lit("; first seen commit "), short_sha(F.element_at(commits, 1)), F.lit("; last seen commit "), short_sha(F.element_at(commits, -1)))
    history = F.when(F.size(commits) >= 2, seen).otherwise("")
    return F.concat(x["path"], span, F.lit(" ("), provenance_summary(x["prov_kind"], x["sha"]), F.lit(", "), F.replace(x["location_class"], F.lit("_"), F.lit("")), history, F.lit(")"))

