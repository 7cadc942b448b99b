"""Working trees, baselines and advisory snapshots as DataFrames."""

from __future__ import annotations

import io
import json
import os
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ENTRY = 16 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for full, path in zip(batch.column("full").to_pylist(), batch.column("path").to_pylist(), strict=True):
            with open(full, "rb") as f:
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([f.read()], pa.binary())], ["path", "content"])


def working_tree(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """path, content, prov_kind, sha, author, date of the files under root; larger ones are not read. What is no UTF-8 stays as it is.

    Spark's own listing leaves out names that begin with a dot, so the driver lists names and sizes of a folder (one that
    driver and executors share) and executors read. A root of another scheme is read by Spark, without such names.
    """
    base = root.removeprefix("file://").rstrip("/")
    if "://" in base:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.col("length") <= max_bytes)
        at = F.instr("path", f"{base.split('://')[-1]}/") + len(base.split("://")[-1]) + 1
        files = files.select(F.substr("path", at).alias("path"), "content")
    else:
        listed = []
        for folder, folders, names in os.walk(base):
            folders[:] = [x for x in folders if x != ".git"]
            for full in (os.path.join(folder, x) for x in names):
                if os.path.isfile(full) and not os.path.islink(full) and os.path.getsize(full) <= max_bytes:
                    listed.append((full, os.path.relpath(full, base).replace(os.sep, "/")))
        names = spark.createDataFrame(listed, "full string, path string").repartition(spark.sparkContext.defaultParallelism)
        files = names.mapInArrow(_read, "path string, content binary")
    none = F.lit(None).cast("string")
    return files.select("path", F.col("content").cast("string").alias("content"), F.lit("working_tree").alias("prov_kind"), none.alias("sha"), none.alias("author"), none.alias("date"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """id of every finding named in a JSON file: a scan result, or an array of ids."""
    text = spark.read.text(path, wholetext=True)
    ids = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.transform(F.from_json("value", "struct<findings:array<struct<id:string>>>")["findings"], lambda x: x["id"]))
    return text.select(F.explode(ids).alias("id")).where("id IS NOT NULL").distinct()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of archives; an archive of which any part cannot be used gives one row with an error and no others."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows: list[tuple[str | None, str | None, str | None, str | None]] = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.filename.endswith(".json"):
                            continue
                        if info.file_size > MAX_ENTRY:
                            raise ValueError(f"entry over {MAX_ENTRY} bytes")
                        for x in json.loads(z.read(info)).get("affected", ()):
                            p = x.get("package", {})
                            rows += [(str(p.get("ecosystem", "")).lower(), str(p.get("name", "")), v, None) for v in x.get("versions", ()) if isinstance(v, str)]
            except (ValueError, AttributeError, KeyError, TypeError, zipfile.BadZipFile, zlib.error, NotImplementedError) as e:
                rows = [(None, path.rsplit("/", 1)[-1], None, type(e).__name__)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["ecosystem", "name", "version", "error"])


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, name, version, error of the snapshot archives at path; with an error, name is the archive."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_entries, "ecosystem string, name string, version string, error string")


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """ecosystem, norm_name, version of the advisories in snapshot archives, but for those that cannot be used (see snapshots())."""
    from palisade.operators.dependencies import normalized_name

    rows = snapshots(spark, path).where("error IS NULL")
    return rows.select("ecosystem", normalized_name(F.col("ecosystem"), F.col("name")).alias("norm_name"), "version").distinct()


def text_array(c):
    """A database's text array, {a,"b"}, as an array."""
    inner = F.regexp_replace(F.trim(c), r"^\{|\}$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', ""))), lambda x: x != "")
