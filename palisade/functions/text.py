"""Columns over lines, tokens and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def lines(c: Column) -> Column:
    """The lines of a text: cut at \\n, without one \\r before it, and without an empty last line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the bytes of a string; 0 for the empty one."""
    digits = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    n = F.size(digits).cast("double")

    def add(total: Column, x: Column) -> Column:
        p = F.size(F.filter(digits, lambda y: y == x)) / n
        return total - p * F.log2(p)

    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(digits), F.lit(0.0), add))


def fingerprint(raw: Column) -> Column:
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 32)


def content_id(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def stable_id(prefix: str | Column, *parts: Column) -> Column:
    """prefix, a dash, and 24 hex digits of the sha256 of the parts joined by NUL; null parts are empty."""
    joined = F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("-"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 24))


def redact(raw: Column) -> Column:
    """*** for up to 12 characters, else the first 6 and last 4."""
    return F.when(F.length(raw) <= 12, F.lit("***")).otherwise(F.concat(F.substring(raw, 1, 6), F.lit("..."), F.right(raw, F.lit(4))))


def normalized_url(url: Column) -> Column:
    """Without slashes at the end, the host in lower case, the path as it is."""
    t = F.regexp_replace(url, "/+$", "")
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://)([^/]*)(.*)$"
    return F.when(t.rlike(parts), F.concat(F.regexp_extract(t, parts, 1), F.lower(F.regexp_extract(t, parts, 2)), F.regexp_extract(t, parts, 3))).otherwise(t)
