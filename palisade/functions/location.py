"""Where a path puts its content: server only, client reachable, or unknown; and the scope of a package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import ascii_lower

# Path segments that decide the class, the server's first.
SERVER_RUNS = ("app/api", "pages/api", "server", "supabase/functions")
CLIENT_RUNS = ("public", "app", "pages", "src/components", "dist", "build", "out", ".next/static", ".svelte-kit", "client")
GROUPS = "apps|packages|services"

_BARE_API = rf"(^api(/|$))|((^|/)({GROUPS})/([^/]+/)?api(/|$))"
_SRC_API = rf"(^src/api(/|$))|((^|/)({GROUPS})/[^/]+/src/api(/|$))"
_SERVER_TEXT = r"""(?s)["']use server["']"""
#: What stands before a quoted text, and the text: quotes pair up from the start of the file, a backslash takes what follows.
_QUOTED = r"""(?s)\G([^"']*+)("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
_IMPORTS = r"(?:^|[^A-Za-z0-9_$])(?:(?:from|import)\s*|(?:import|require)\s*\(\s*)\z"


def server_signal(content: Column) -> Column:
    """A "use server" directive, or an import of next/server or a node: module."""

    def named(q: Column) -> Column:
        value = F.substring(q["text"], 2, F.length(q["text"]) - 2)
        return q["before"].rlike(_IMPORTS) & ((value == "next/server") | value.startswith("node:"))

    quoted = F.arrays_zip(F.regexp_extract_all(content, F.lit(_QUOTED), F.lit(1)).alias("before"), F.regexp_extract_all(content, F.lit(_QUOTED), F.lit(2)).alias("text"))
    maybe = F.contains(content, F.lit("next/server")) | F.contains(content, F.lit("node:"))
    return F.coalesce(content.rlike(_SERVER_TEXT) | (maybe & F.exists(quoted, named)), F.lit(False))


def location_class(path: Column, content: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(ascii_lower(path), "/+", "/"), "^/|/$", "")
    padded = F.concat(F.lit("/"), clean, F.lit("/"))
    name = F.element_at(F.split(clean, "/"), -1)

    def runs(values: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | F.contains(padded, F.lit(f"/{v}/"))
        return out

    src_api = clean.rlike(_SRC_API)
    server = (name == ".env") | name.startswith(".env.") | runs(SERVER_RUNS) | clean.rlike(_BARE_API) | (src_api & server_signal(content))
    client = runs(CLIENT_RUNS) | F.contains(name, F.lit(".client.")) | src_api
    return F.when(server, "server_only").when(client, "client_reachable").otherwise("unknown")


def source_scope(path: Column) -> Column:
    """The first apps/x, packages/x or services/x of a path, else "."."""
    found = F.regexp_extract(path, rf"(?:^|/)((?:{GROUPS})/[^/]+)(?:/|$)", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)
