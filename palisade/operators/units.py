"""Files to units: filters, one unit for each content, locations merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.location import location_class
from palisade.functions.text import content_id

# Globs that are read whatever else says, and that are never read.
ALWAYS_SCAN = (".env", ".env.*", "**/.env", "**/.env.*", "dist/**", "**/dist/**", "build/**", "**/build/**", "out/**", "**/out/**", ".next/static/**", "**/.next/static/**")
ALWAYS_SKIP = ("**/node_modules/**", "**/vendor-chunks/**", "**/.next/cache/**", "**/.next/server/**", "**/__pycache__/**", "**/*.pyc", "**/.DS_Store", "**/.turbo/**", "**/coverage/**", ".git/**", "target/**", ".env.example", ".env.sample", "**/.env.example", "**/.env.sample", "*.example", "**/*.example", "*.sample", "**/*.sample")


def glob_pattern(globs) -> str:
    """One pattern that matches the paths of any of the globs: * within a segment, ** across segments."""

    def one(g: str) -> str:
        out, i = "", 0
        while i < len(g):
            if g.startswith("**/", i):
                out, i = f"{out}(?:.*/)?", i + 3
            elif g.startswith("**", i):
                out, i = f"{out}.+", i + 2
            elif g[i] == "*":
                out, i = f"{out}[^/]*", i + 1
            elif g[i] == "?":
                out, i = f"{out}[^/]", i + 1
            else:
                out, i = out + (g[i] if g[i].isalnum() or g[i] in "/_-" else f"\\{g[i]}"), i + 1
        return out

    return f"(?s)^(?:{'|'.join(map(one, globs))})$"


def should_scan(path: Column, config_skip: tuple[str, ...] = (), ignored: Column | None = None) -> Column:
    """Never-read globs first, then always-read ones, then those of the configuration, then the ignore files' verdict."""
    out = F.when(path.rlike(glob_pattern(ALWAYS_SKIP)), False).when(path.rlike(glob_pattern(ALWAYS_SCAN)), True)
    if config_skip:
        out = out.when(path.rlike(glob_pattern(config_skip)), False)
    return out.otherwise(F.lit(True) if ignored is None else ~ignored)


def scannable(files: DataFrame, max_bytes: int = 4 << 20, config_skip: tuple[str, ...] = (), ignored: Column | None = None) -> DataFrame:
    """Files that are to be read, small enough, and without a NUL."""
    return files.where(should_scan(F.col("path"), config_skip, ignored) & (F.octet_length("content") <= max_bytes) & ~F.contains("content", F.lit("\0")))


def skipped(files: DataFrame, max_bytes: int = 4 << 20, config_skip: tuple[str, ...] = (), ignored: Column | None = None) -> DataFrame:
    """kind, message of the files that scannable() leaves out for their size or for a NUL; each once."""
    rows = files.where(should_scan(F.col("path"), config_skip, ignored))
    large = F.octet_length("content") > max_bytes
    kind = F.when(large, "large_file_skipped").when(F.contains("content", F.lit("\0")), "binary_file_skipped")
    size = F.octet_length("content").cast("string")
    message = F.when(large, F.concat(F.lit("large file skipped: "), "path", F.lit(" ("), size, F.lit(" bytes)"))).otherwise(F.concat(F.lit("binary file skipped: "), "path"))
    return rows.select(kind.alias("kind"), message.alias("message")).where("kind IS NOT NULL").distinct()


def collect_units(files: DataFrame) -> DataFrame:
    """content_id, content, locations from files(path, content, prov_kind, sha, author, date).

    The same content at any number of paths and commits is one unit. Locations are aggregated by content id and path without the
    text; one copy of each text is kept by content id, copies being combined before the shuffle, and joined where it already
    is. Provenances of a path are sorted, the working tree first; the first one is the primary. The places of one content
    are one array, as large as its paths and commits are many.
    """
    identity = content_id(F.col("content"))
    prov = F.struct((F.col("prov_kind") != "working_tree").alias("rank"), F.col("sha"), F.col("author"), F.col("date"), F.col("prov_kind"))
    places = files.select(identity.alias("content_id"), "path", location_class(F.col("path"), F.col("content")).alias("location_class"), prov.alias("prov")).groupBy("content_id", "path", "location_class").agg(F.array_sort(F.collect_set("prov")).alias("provs"))
    where = F.struct("path", F.col("provs")[0]["prov_kind"].alias("prov_kind"), F.col("provs")[0]["sha"].alias("sha"), F.transform("provs", lambda p: F.coalesce(p["sha"], F.lit(""))).alias("shas"), "location_class")
    located = places.groupBy("content_id").agg(F.array_sort(F.collect_list(where)).alias("locations"))
    texts = files.select(identity.alias("content_id"), "content").groupBy("content_id").agg(F.any_value("content").alias("content"))
    return texts.join(located, "content_id")


def counters(files: DataFrame) -> DataFrame:
    """paths, blobs, unique contents and the share of blobs that were copies."""
    out = files.select("path", content_id(F.col("content")).alias("content_id")).agg(F.count_distinct("path").alias("paths_seen"), F.count("*").alias("blobs_read"), F.count_distinct("content_id").alias("unique_contents"))
    return out.withColumn("dedup_ratio", F.coalesce(F.lit(1.0) - F.col("unique_contents") / F.nullif(F.col("blobs_read"), F.lit(0)), F.lit(0.0)))
