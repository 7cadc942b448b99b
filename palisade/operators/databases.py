"""Database addresses: which may be used, and the project they belong to. Messages never hold an address."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, unquote, urlsplit

from palisade.functions.keys import DOMAIN

# Schemes, ports, modes and hosts that are accepted.
SCHEMES, PORTS, TLS_MODES = ("postgres", "postgresql"), (5432, 6543), ("require", "verify-ca", "verify-full")
OVERRIDES = ("host", "hostaddr", "port")
POOLER = "pooler.supabase.com"
_REF = re.compile(r"[a-z0-9-]+")
_POOLER_HOST = re.compile(rf"(?:[a-z0-9-]+\.)+{re.escape(POOLER)}")


class DatabaseError(ValueError):
    """An address that may not be used; the message says why without showing it."""


@dataclass(frozen=True, repr=False)
class Target:
    """Where a database is; the address itself is not kept."""

    host: str
    port: int
    project_ref: str

    @property
    def project_url(self) -> str:
        return f"https://{self.project_ref}.{DOMAIN}"


def _ref(name: str, reason: str) -> str:
    if not _REF.fullmatch(name):
        raise DatabaseError(reason)
    return name


def project_ref(url: str) -> str | None:
    """The name in a project's address."""
    found = re.fullmatch(rf"https://([a-z0-9-]+)\.{re.escape(DOMAIN)}", url.rstrip("/"))
    return found[1] if found else None


def target(address: str, project_url: str | None = None) -> Target:
    """Checks an address (TLS, ports, hosts, no overrides; of that project, if one is given) and says where it leads."""
    try:
        parts = urlsplit(address)
        port = parts.port or 5432
        host = (parts.hostname or "").lower()
    except ValueError:
        raise DatabaseError("expected a postgres:// or postgresql:// connection URL") from None
    if parts.scheme not in SCHEMES:
        raise DatabaseError("scheme must be postgres or postgresql")
    if parts.fragment or address.rstrip().endswith("#"):
        raise DatabaseError("fragments are not allowed")
    for name, value in parse_qsl(parts.query, keep_blank_values=True):
        if name in OVERRIDES:
            raise DatabaseError("host and port overrides are not allowed")
        if name == "sslmode" and value not in TLS_MODES:
            raise DatabaseError("TLS cannot be disabled or downgraded")
    if not host:
        raise DatabaseError("database host is required")
    if port not in PORTS:
        raise DatabaseError("only database ports 5432 and 6543 are allowed")
    if host.startswith("db."):
        if not host.endswith(f".{DOMAIN}"):
            raise DatabaseError("host is not a database host")
        ref = _ref(host[3 : -len(DOMAIN) - 1], "database host has an invalid project reference")
    elif _POOLER_HOST.fullmatch(host):
        _, dot, name = unquote(parts.username or "").rpartition(".")
        if not dot:
            raise DatabaseError("pooler username must include the project reference")
        ref = _ref(name, "pooler username has an invalid project reference")
    else:
        raise DatabaseError("host is not a database or pooler host")
    if project_url is not None:
        wanted = project_ref(project_url)
        if wanted is None:
            raise DatabaseError("expected project has no valid reference")
        if wanted != ref:
            raise DatabaseError(f"the address is of project {ref}, not of {wanted}")
    return Target(host, port, ref)
