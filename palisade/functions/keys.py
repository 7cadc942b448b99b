"""What a key is: its class, severity, confidence and project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and the domain of projects.
PUBLISHABLE, SECRET, DOMAIN = "sb_publishable_", "sb_secret_", "supabase.co"
ELEVATED = ("secret_new", "service_role_legacy")
PUBLIC = ("publishable_new", "anon_legacy")


def claims(raw: Column) -> Column:
    """The JSON text of a three-part token's payload; null if it is not base64url without padding, or not an object."""
    parts = F.split(raw, r"\.")
    body = parts[1]
    plain = F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64"))
    text = F.when(F.is_valid_utf8(F.decode(plain, "UTF-8")), F.decode(plain, "UTF-8"))
    return F.when((F.size(parts) == 3) & body.rlike("^[A-Za-z0-9_-]+$") & text.rlike(r"(?s)^\s*\{.*\}\s*$"), text)


def claim(payload: Column, name: str) -> Column:
    """A string member of a JSON text, null if it is missing or not a string."""
    v = F.try_parse_json(payload)
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def project_hint(content: Column) -> Column:
    """The first project address in a text; null if there is none."""
    found = F.regexp_extract(content, r"(https://[a-z0-9-]+\.supabase\.co)", 1)
    return F.when(found != "", found)


# What is said of each class.
TITLES = {
    "publishable_new": "Supabase publishable key found",
    "secret_new": "Supabase secret key exposed",
    "anon_legacy": "Supabase legacy anon key found",
    "service_role_legacy": "Supabase legacy service_role key exposed",
    "unknown": "Supabase-shaped key requires review",
}
DETAILS = {
    "publishable_new": "A new-format Supabase publishable key was found. This key is low privilege by itself and must be evaluated together with RLS exposure.",
    "secret_new": "A new-format Supabase secret key was found. Secret keys are elevated credentials and bypass RLS.",
    "anon_legacy": "A legacy Supabase anon JWT was found. This key is low privilege by itself and must be evaluated together with RLS exposure.",
    "service_role_legacy": "A legacy Supabase service_role JWT was found. Service role keys are elevated credentials and bypass RLS.",
    "unknown": "The value matched a Supabase-shaped rule but could not be classified as a known Supabase key class.",
}
NO_ROLE = "Supabase-shaped JWT has no recognized Supabase role"
_KEEP = "Keep the public key client-side only if RLS policies are correct. Enable network probing later to verify table exposure."
_ROTATE = "Rotate the key immediately, remove it from the repository, and rewrite git history if the key was committed."
REMEDIATIONS = {
    "publishable_new": _KEEP,
    "secret_new": _ROTATE,
    "anon_legacy": _KEEP,
    "service_role_legacy": _ROTATE,
    "unknown": "Review the value and remove it if it is a real Supabase credential.",
}


def classified(raw: Column, hint: Column) -> Column:
    """struct(key_class, severity, confidence, project_url, detail) of a raw key; hint is the project named beside it."""
    payload = claims(raw)
    issuer, role, ref = claim(payload, "iss"), claim(payload, "role"), claim(payload, "ref")
    known = F.coalesce((F.lower(issuer) == "supabase") | F.contains(F.lower(issuer), F.lit(f".{DOMAIN}")), F.lit(False))
    own = F.when(ref.isNotNull(), F.concat(F.lit("https://"), ref, F.lit(f".{DOMAIN}")))
    none = F.lit(None).cast("string")

    def row(key_class: str, severity: str, confidence: str, project: Column, detail: str | None = None) -> Column:
        said = F.lit(detail or DETAILS[key_class]).alias("detail")
        return F.struct(F.lit(key_class).alias("key_class"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), project.alias("project_url"), said)

    return (
        F.when(raw.startswith(PUBLISHABLE), row("publishable_new", "info", "likely", hint))
        .when(raw.startswith(SECRET), row("secret_new", "critical", "likely", hint))
        .when(known & (role == "anon"), row("anon_legacy", "info", "likely", own))
        .when(known & (role == "service_role"), row("service_role_legacy", "critical", "likely", own))
        .when(known, row("unknown", "low", "review", none, NO_ROLE))
        .otherwise(row("unknown", "low", "review", none))
    )
