"""Findings against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall of found against truth, as multisets by key."""
    a = found.groupBy(*key).agg(F.count("*").alias("f"))
    b = truth.groupBy(*key).agg(F.count("*").alias("t"))
    both = a.join(b, key, "full_outer").select(F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("t", F.lit(0)).alias("t"))
    out = both.agg(F.coalesce(F.sum(F.least("f", "t")), F.lit(0)).alias("true_positives"), F.coalesce(F.sum(F.greatest(F.col("f") - F.col("t"), F.lit(0))), F.lit(0)).alias("false_positives"), F.coalesce(F.sum(F.greatest(F.col("t") - F.col("f"), F.lit(0))), F.lit(0)).alias("false_negatives"))
    tp = F.col("true_positives")
    return out.withColumns({"precision": F.coalesce(tp / F.nullif(tp + F.col("false_positives"), F.lit(0)), F.lit(1.0)), "recall": F.coalesce(tp / F.nullif(tp + F.col("false_negatives"), F.lit(0)), F.lit(1.0))})


def coverage(findings: DataFrame) -> DataFrame:
    """keys, classified, coverage: of the keys found, those whose class is known, and their share (1 if there are none)."""
    out = findings.where("key_class IS NOT NULL").agg(F.count("*").alias("keys"), F.count_if(F.col("key_class") != "unknown").alias("classified"))
    return out.withColumn("coverage", F.coalesce(F.col("classified") / F.nullif(F.col("keys"), F.lit(0)), F.lit(1.0)))
