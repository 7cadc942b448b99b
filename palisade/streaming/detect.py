"""Detection over a stream of files: stateless lines to candidates, findings merged by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.rules import DEFAULT, Ruleset
from palisade.functions.text import content_id, fingerprint, redact
from palisade.operators.detect import detect


def stream_findings(files: DataFrame, ruleset: Ruleset = DEFAULT) -> DataFrame:
    """content_id, path, rule_id, line_no, fingerprint, redacted of a stream of files(path, content)."""
    none = F.lit(None).cast("string")
    place = F.struct("path", F.lit("working_tree").alias("prov_kind"), none.alias("sha"), F.array().cast("array<string>").alias("shas"), F.lit("unknown").alias("location_class"))
    found = detect(files.select(content_id(F.col("content")).alias("content_id"), "content", F.array(place).alias("locations")), ruleset)
    return found.select("content_id", F.get("locations", F.lit(0))["path"].alias("path"), "rule_id", "line_no", fingerprint(F.col("raw")).alias("fingerprint"), redact(F.col("raw")).alias("redacted"))


def write(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's findings, once each, as Parquet under path."""
    def put(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return findings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
