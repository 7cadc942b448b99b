"""Units to secret candidates, all rules in one pass over the lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.keys import project_hint
from palisade.functions.rules import DEFAULT, Allowlist, Rule, Ruleset, java_pattern
from palisade.functions.text import entropy, lines


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _holds(text: Column, words) -> Column:
    """Whether a text holds any of the words, A-Z and a-z being the same: one pass of one pattern, without a lower-case copy."""
    quoted = "|".join(rf"\Q{w}\E" for w in sorted(words))
    return text.rlike(f"(?i)(?:{quoted})")


#: Marks both ends of a match in a line; taken out of lines before.
_MARK = "\uf8ff"


def _listed(a: Allowlist, line: Column, raw: Column, location: Column) -> Column:
    tests = [location["path"].rlike(java_pattern(p)) for p in a.paths] + [line.rlike(java_pattern(p)) for p in a.regexes] + [F.contains(raw, F.lit(w)) for w in a.stopwords]
    if a.commits:
        tests.append(F.arrays_overlap(location["shas"], F.array(*map(F.lit, a.commits))))
    return _any(tests)


def detect(units: DataFrame, ruleset: Ruleset = DEFAULT) -> DataFrame:
    """content_id, hint, rule_id, kind, line_no, col_start, col_end, raw, entropy, locations; one row for each match that some location keeps.

    units has content_id, content and locations; hint is the project that the unit names, found before its lines are cut. Units, and
    then lines, that no keyword of any rule is in are dropped before any other pattern runs; entropy is computed for matches only. Of
    a match the first occurrence of its group is its place. raw is for internal use: take findings_of() for output.
    """
    words = {k for r in ruleset.rules for k in r.keywords}
    all_have = all(r.keywords for r in ruleset.rules)
    rows = units.where(F.is_valid_utf8("content"))
    if all_have:
        rows = rows.where(_holds(F.col("content"), words))
    # Generators are outer ones: for others the optimizer adds a filter that computes their arrays a second time.
    rows = rows.select("content_id", "locations", project_hint(F.col("content")).alias("hint"), F.posexplode_outer(lines(F.col("content"))).alias("at", "line"))
    rows = rows.where(_holds(F.col("line"), words) if all_have else F.col("line").isNotNull())
    if ruleset.allow_marker:
        rows = rows.where(~F.contains("line", F.lit(ruleset.allow_marker)))
    line = F.replace(F.col("line"), F.lit(_MARK), F.lit("\ufffd"))

    def hits(r: Rule) -> Column:
        applies = _holds(F.col("line"), r.keywords) if r.keywords else F.lit(True)
        if r.kind == "generic_high_entropy":
            applies = applies & (F.octet_length("line") <= ruleset.max_minified_line)
        return F.when(applies, F.regexp_extract_all(line, F.lit(java_pattern(r.regex)), F.lit(r.secret_group)))

    found = F.explode_outer(F.array(*(F.struct(F.lit(i).alias("rule"), hits(r).alias("raws")) for i, r in enumerate(ruleset.rules)))).alias("hit")
    rows = rows.select("content_id", "hint", "locations", line.alias("line"), (F.col("at") + 1).alias("line_no"), found).where(F.size("hit.raws") > 0)

    # The line with both ends of each match marked, so that what stands before, and anchors, count as they do for the match itself.
    marked = F.lit(None).cast("string")
    for i, r in enumerate(ruleset.rules):
        marked = F.when(F.col("hit.rule") == i, F.regexp_replace("line", java_pattern(r.regex), f"{_MARK}$0{_MARK}")).otherwise(marked)
    rows = rows.select("content_id", "hint", "locations", "line", "line_no", F.col("hit.rule").alias("rule"), F.split(marked, _MARK).alias("pieces"), F.posexplode_outer("hit.raws").alias("nth", "raw"))
    before = F.aggregate(F.slice("pieces", 1, 2 * F.col("nth") + 1), F.lit(0), lambda n, x: n + F.length(x))
    start = (before + F.call_function("locate", F.col("raw"), F.get("pieces", 2 * F.col("nth") + 1))).cast("int")
    rows = rows.select("content_id", "hint", "locations", "line", "line_no", "rule", "raw", start.alias("col_start")).withColumn("col_end", F.col("col_start") + F.length("raw"))
    rows = rows.withColumn("entropy", entropy(F.col("raw")))
    line, raw = F.col("line"), F.col("raw")
    threshold, kept = F.lit(None).cast("double"), F.lit(None)
    rule_id = kind = F.lit(None).cast("string")
    for i, r in enumerate(ruleset.rules):
        mine = F.col("rule") == i
        threshold = F.when(mine, F.lit(r.entropy).cast("double")).otherwise(threshold)
        rule_id = F.when(mine, F.lit(r.id)).otherwise(rule_id)
        kind = F.when(mine, F.lit(r.kind)).otherwise(kind)

    def stays(x: Column) -> Column:
        out = ~_any([_listed(a, line, raw, x) for a in ruleset.allowlists])
        for i, r in enumerate(ruleset.rules):
            if r.path_allowlist or r.allowlists:
                own = _any([x["path"].rlike(java_pattern(p)) for p in r.path_allowlist] + [_listed(a, line, raw, x) for a in r.allowlists])
                out = out & ~((F.col("rule") == i) & own)
        return out

    rows = rows.where(F.coalesce(F.col("entropy") >= threshold, F.lit(True))).withColumn("locations", F.filter("locations", stays)).where(F.size("locations") > 0)
    return rows.select("content_id", "hint", rule_id.alias("rule_id"), kind.alias("kind"), F.col("line_no").cast("int").alias("line_no"), "col_start", "col_end", "raw", "entropy", "locations")


def spans(locations: str = "locations") -> Column:
    """Locations with the place of a candidate."""
    return F.transform(locations, lambda x: F.struct(x["path"].alias("path"), F.col("line_no").alias("line"), F.col("col_start").alias("col_start"), F.col("col_end").alias("col_end"), x["prov_kind"].alias("prov_kind"), x["sha"].alias("sha"), x["shas"].alias("shas"), x["location_class"].alias("location_class")))
