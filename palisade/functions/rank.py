"""Orders of the enumerations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CATEGORIES = ["secret_exposure", "key_classification", "rls", "dependency_integrity", "correlation"]
LOCATION_CLASSES = {"unknown": 0, "server_only": 1, "client_reachable": 2}
# Names as they enter ids and texts.
KEY_CLASS_NAMES = {"publishable_new": "PublishableNew", "secret_new": "SecretNew", "anon_legacy": "AnonLegacy", "service_role_legacy": "ServiceRoleLegacy", "unknown": "Unknown"}
EXPOSURE_NAMES = {"exposed": "Exposed", "rls_disabled": "RlsDisabled", "permissive_policy": "PermissivePolicy", "missing_operation_policy": "MissingOperationPolicy", "inferred_write_exposure": "InferredWriteExposure"}
ECOSYSTEM_NAMES = {"npm": "Npm", "pypi": "PyPi"}
REASON_NAMES = {"invalid_package_name": "InvalidPackageName", "empty_version_specifier": "EmptyVersionSpecifier", "known_malicious": "KnownMalicious", "nonexistent_package": "NonexistentPackage"}


def mapped(c: Column, values: dict, otherwise=None) -> Column:
    """c looked up in values, by a chain of equalities."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def severity_rank(c: Column) -> Column:
    return mapped(c, SEVERITIES, 0)


def category_rank(c: Column) -> Column:
    return mapped(c, {x: i for i, x in enumerate(CATEGORIES)}, len(CATEGORIES))


def location_rank(c: Column) -> Column:
    return mapped(c, LOCATION_CLASSES, 0)


def sarif_level(c: Column) -> Column:
    return mapped(c, {"critical": "error", "high": "error", "medium": "warning"}, "note")


def security_severity(c: Column) -> Column:
    return mapped(c, {"critical": "9.5", "high": "8.0", "medium": "5.0", "low": "2.5"}, "0.0")


def parse_severity(name: str) -> str:
    found = name.strip().lower()
    if found not in SEVERITIES:
        raise ValueError(f"unknown severity {name!r}")
    return found
