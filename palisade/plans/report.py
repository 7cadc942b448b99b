"""Reports of a scan: JSON, SARIF, text, HTML. Findings are collected here, and only here."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.rank import SEVERITIES, mapped, sarif_level, security_severity
from palisade.operators.correlate import ranked
from palisade.operators.findings import location_summary, provenance_summary

FORMATS = ("json", "sarif", "text", "html")
COLORS = {"critical": "\x1b[1;31m", "high": "\x1b[31m", "medium": "\x1b[33m", "low": "\x1b[36m", "info": "\x1b[2m"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

# Words for enumerations.
CLASS_NAMES = {"unknown": "Unknown", "server_only": "ServerOnly", "client_reachable": "ClientReachable"}
OUTCOMES = ("root_enumerated", "root_unavailable", "exposed", "no_rows_observed", "protected", "not_found", "key_rejected", "invalid_response", "transport_error", "catalog_read", "registry_resolved", "advisory_fetched")
ECOSYSTEMS = {"npm": "npm", "pypi": "PyPI"}


def sarif_results(findings: DataFrame, *more: str) -> DataFrame:
    """id, level, security_severity, message, places(uri, start_line, start_column, end_column, provenance, class) of each finding; then columns that are named."""

    def one(x: Column) -> Column:
        return F.struct(
            x["path"].alias("uri"), x["line"].alias("start_line"), x["col_start"].alias("start_column"), x["col_end"].alias("end_column"),
            provenance_summary(x["prov_kind"], x["sha"]).alias("provenance"), mapped(x["location_class"], CLASS_NAMES, "Unknown").alias("location_class"),
        )

    return findings.select(
        "id", sarif_level(F.col("severity")).alias("level"), security_severity(F.col("severity")).alias("security_severity"), F.concat("title", F.lit(": "), "evidence").alias("message"), F.transform("locations", one).alias("places"), *more,
    )


def action_summary(kind: Column, intent: Column, endpoint: Column, table: Column, package: Column, status: Column, outcome: Column, rows: Column) -> Column:
    """One line about an answer that was looked up."""

    def part(before: str, value: Column, after: str = "") -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(before), value.cast("string"), F.lit(after))).otherwise("")

    return F.concat(
        F.upper(intent), F.lit(" "), F.replace(kind, F.lit("_"), F.lit(" ")), part(" for table ", table), part(" for package ", package), F.lit(" at "), endpoint, F.lit(" -> "),
        F.replace(outcome, F.lit("_"), F.lit(" ")), part("; HTTP ", status), part("; observed ", rows, " row(s)"),
    )


def egress_summary(ecosystem: Column, host: Column) -> Column:
    return F.concat(mapped(ecosystem, ECOSYSTEMS), F.lit(" package names sent to "), host)


def history_summary(history: bool, budget: int | None, scanned: int, truncated: bool) -> str:
    if not history:
        return "history disabled"
    if budget is None:
        return f"history exhaustive {scanned} commits"
    return f"history budgeted {scanned}/{budget} commits{' truncated' if truncated else ''}"


def stats_value(stats: dict[str, int], truncated: bool) -> dict:
    """The numbers of a scan as reports have them."""
    read = stats["blobs_read"]
    percent = 100 * (1 - stats["unique_contents"] / read) if read else 0.0
    return {
        "pathsWalked": stats["paths_seen"], "blobsRead": read, "uniqueContents": stats["unique_contents"], "dedupRatioPercent": f"{percent:.2f}",
        "unitsMaterialized": stats["unique_contents"], "truncated": truncated, "scanBudgetHit": bool(stats["scan_budget_hit"]),
    }


class Report:
    """A scan's result in memory: findings hold no raw values, so none can appear."""

    def __init__(self, scan) -> None:
        rows = ranked(scan.findings).withColumn("summaries", F.transform("locations", location_summary)).withColumn("level", sarif_level(F.col("severity"))).withColumn("security_severity", security_severity(F.col("severity")))
        self.findings = [r.asDict(recursive=True) for r in rows.collect()]
        self.places = {r.id: [x.asDict() for x in r.places] for r in sarif_results(scan.findings).collect()}
        self.stats = {r["name"]: r["value"] for r in scan.stats.collect()}
        self.warnings = [r.message for r in scan.warnings.select("message").distinct().orderBy("message").collect()]
        columns = ("kind", "intent", "endpoint", "table", "package", "status", "outcome", "observed_rows")
        actions = scan.actions.withColumn("summary", action_summary(*(F.col(c) for c in columns))).orderBy("endpoint", "table", "package", "status")
        self.actions = [r.asDict() for r in actions.collect()]
        self.egress = [r.asDict() for r in scan.egress.withColumn("summary", egress_summary(F.col("ecosystem"), F.col("host"))).orderBy("ecosystem", "host").collect()]
        self.scope = scan.scope
        self.version, self.started_at, self.duration_ms = scan.version, scan.started_at, scan.duration_ms
        self.numbers = stats_value(self.stats, scan.scope["truncated"])
        self.history = history_summary(*(scan.scope[k] for k in ("history", "max_commits", "scanned_commits", "truncated")))

    def _actions(self) -> list[dict]:
        return [{k: v for k, v in a.items() if k != "summary"} for a in self.actions]

    def json(self) -> str:
        hidden = ("summaries", "level", "security_severity")
        found = [{k: v for k, v in r.items() if k not in hidden} for r in self.findings]
        network = {"enabled": self.scope["network"], "actions": self._actions(), "registry_name_egress": [{"ecosystem": e["ecosystem"], "host": e["host"]} for e in self.egress]}
        scope = {**self.scope, "network": network, "warnings": self.warnings}
        return json.dumps({"findings": found, "scope": scope, "tool_version": self.version, "started_at": self.started_at, "duration_ms": self.duration_ms, "stats": self.stats}, indent=2, ensure_ascii=False)

    def sarif(self) -> str:
        rules, results = [], []
        for r in self.findings:
            common = {"category": r["category"], "confidence": r["confidence"]}
            rules.append({"id": r["id"], "name": r["title"], "shortDescription": {"text": r["title"]}, "fullDescription": {"text": r["detail"]}, "help": {"text": r["remediation"]}, "properties": {**common, "security-severity": r["security_severity"]}})
            places = []
            for x in self.places[r["id"]]:
                region = {"startLine": x["start_line"], "startColumn": x["start_column"], "endColumn": x["end_column"]} if x["start_line"] else {}
                places.append({"physicalLocation": {"artifactLocation": {"uri": x["uri"]}, "region": region}, "properties": {"provenance": x["provenance"], "locationClass": x["location_class"]}})
            results.append({"ruleId": r["id"], "level": r["level"], "message": {"text": f"{r['title']}: {r['evidence']}"}, "locations": places, "properties": {"severity": r["severity"], **common, "related": r["related"]}})
        said = {
            "target": self.scope["target"], "history": self.history, "networkEnabled": self.scope["network"], "networkActions": self._actions(), "registryChecks": self.scope["registry_checks"],
            "registryNameEgress": [e["summary"] for e in self.egress], "scanStats": self.numbers, "warnings": self.warnings,
        }
        driver = {"name": "palisade", "version": self.version, "rules": rules}
        return json.dumps({"version": "2.1.0", "$schema": SCHEMA, "runs": [{"tool": {"driver": driver}, "invocations": [{"executionSuccessful": True, "properties": said}], "results": results}]}, indent=2, ensure_ascii=False)

    def text(self, color: bool = False) -> str:
        n = self.numbers
        out = [
            f"palisade {self.version} - {len(self.findings)} finding(s) in {self.duration_ms} ms",
            f"collection: paths {n['pathsWalked']} | blobs {n['blobsRead']} | unique {n['uniqueContents']} | dedup {n['dedupRatioPercent']}% | units {n['unitsMaterialized']} | truncated {'yes' if n['truncated'] else 'no'}",
            f"target: {self.scope['target']} | scope: {self.history} | network: {'enabled' if self.scope['network'] else 'disabled'}",
        ]
        for title, lines in (("warnings", self.warnings), ("network actions", [a["summary"] for a in self.actions]), ("registry package-name egress", [e["summary"] for e in self.egress])):
            if lines:
                out += ["", f"{title}:", *(f"  - {x}" for x in lines)]
        if not self.findings:
            return "\n".join([*out, "", "No findings."]) + "\n"
        out.append("")
        for r in self.findings:
            name = r["severity"].upper()
            shown = f"{COLORS[r['severity']]}{name}\x1b[0m" if color else name
            out += [f"{shown} {r['title']} [{r['category']}]", f"  id: {r['id']}", f"  confidence: {r['confidence']}", *(f"  location: {x}" for x in r["summaries"]), f"  evidence: {r['evidence']}", f"  remediation: {r['remediation']}"]
            if r["related"]:
                out.append(f"  related: {', '.join(r['related'])}")
        return "\n".join(out) + "\n"

    def html(self) -> str:
        n, e = self.numbers, html.escape
        pills = [f"findings: {len(self.findings)}", f"scope: {e(self.history)}", f"paths: {n['pathsWalked']}", f"blobs: {n['blobsRead']}", f"unique: {n['uniqueContents']}", f"dedup: {n['dedupRatioPercent']}%", f"units: {n['unitsMaterialized']}", f"truncated: {'yes' if n['truncated'] else 'no'}"]
        pills += [f"<span class='sev {s}'>{s.upper()}</span>: {count}" for s in SEVERITIES if (count := self.stats[f"by_severity.{s}"])]
        out = ["<!doctype html><html lang='en'><head><meta charset='utf-8'><title>palisade report</title></head><body><main><h1>palisade report</h1>"]
        out.append(f"<div class='meta'>target: {e(self.scope['target'])} | version: {e(self.version)} | duration: {self.duration_ms} ms | network: {'enabled' if self.scope['network'] else 'disabled'}</div>")
        out.append("<section class='summary'>" + "".join(f"<div class='pill'>{p}</div>" for p in pills) + "</section>")
        for title, lines in (("Warnings", self.warnings), ("Network actions", [a["summary"] for a in self.actions]), ("Registry package-name egress", [x["summary"] for x in self.egress])):
            if lines:
                out.append(f"<section><h2>{title}</h2><ul>" + "".join(f"<li>{e(x)}</li>" for x in lines) + "</ul></section>")
        out.append("<section><h2>Findings</h2>" + ("" if self.findings else "<p>No findings.</p>"))
        for r in self.findings:
            places = "".join(f"<p class='mono'>{e(x)}</p>" for x in r["summaries"])
            out.append(
                f"<article class='finding'><h3><span class='sev {r['severity']}'>{r['severity'].upper()}</span> {e(r['title'])}</h3><p class='detail'>{e(r['id'])} | {r['category']} | confidence: {r['confidence']}</p>"
                f"<p>{e(r['detail'])}</p>{places}<div class='evidence'>{e(r['evidence'])}</div><p><strong>Remediation:</strong> {e(r['remediation'])}</p></article>"
            )
        return "".join(out) + "</section></main></body></html>"


def render(scan, kind: str = "json", color: bool = False) -> str:
    """One report of a scan as text."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    report = Report(scan)
    return report.text(color) if kind == "text" else getattr(report, kind)()
