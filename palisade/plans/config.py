"""Settings of a scan: defaults, then a TOML file at the root, then what the caller says."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, replace

from palisade.functions.rank import parse_severity

NAME = "palisade.toml"


class ConfigError(ValueError):
    """Settings that cannot be used."""


@dataclass(frozen=True)
class ScanConfig:
    working_tree: bool = True
    history: bool = True
    #: None: all commits.
    max_commits: int | None = 2000
    max_bytes: int = 4 << 20
    severity_gate: str = "high"
    ignore_paths: tuple[str, ...] = ()
    baseline: str | None = None
    rules: str | None = None
    #: Whether recorded answers of probes, catalogs and registries take part; a file can switch these off, never on.
    tier0_read_probe: bool = False
    tier1_introspection: bool = False
    registry_checks: bool = False


_SCAN = {"working_tree": bool, "history": bool, "max_commits": int, "max_bytes": int}
_NETWORK = ("tier0_read_probe", "tier1_introspection", "registry_checks")


def load(root: str, base: ScanConfig | None = None) -> ScanConfig:
    """base (the defaults) with the settings of the file at root, if there is one; its paths are relative to root."""
    base = base or ScanConfig()
    path = os.path.join(root, NAME)
    if not os.path.exists(path):
        return base
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    own, changes = found.get("scan", {}), {}
    for name, kind in _SCAN.items():
        if name in own:
            if not isinstance(own[name], kind) or kind is int and isinstance(own[name], bool):
                raise ConfigError(f"{path}: {name} must be of type {kind.__name__}")
            changes[name] = own[name]
    if "severity_gate" in own:
        try:
            changes["severity_gate"] = parse_severity(str(own["severity_gate"]))
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from e
    changes["ignore_paths"] = base.ignore_paths + tuple(found.get("ignore", {}).get("paths", ()))
    for name in ("baseline", "rules"):
        if name in found:
            changes[name] = os.path.join(root, found[name]["path"]) if found[name].get("path") else None
    changes |= {name: False for name in _NETWORK if found.get("network", {}).get(name) is False}
    return replace(base, **changes)
