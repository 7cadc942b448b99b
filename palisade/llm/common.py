"""Helpers shared by the document operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.plans.shared import checkpointed, shared_folder  # noqa: F401

#: Words are maximal runs of other characters than these; bytes.split() without arguments cuts at exactly them.
WHITE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Sizes above this are Spark's way of saying that it knows nothing.
UNKNOWN_BYTES = 1 << 60
#: A key is hot from this part of an average partition on, and from so many rows.
HOT_SHARE, HOT_LEAST = 4, 50


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int | None:
    """Spark's estimate of the size of df in bytes, without running it; None where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if n >= UNKNOWN_BYTES else n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined_by_size(left: DataFrame, right: DataFrame, key: str, size: str = "size") -> DataFrame:
    """left joined with right by key, where right has one row for each key and in column size how many rows of left have it.

    Keys that make up more than a small share of all rows are joined by broadcast, so that no task gets them whole: as
    each has at least a HOT_SHARE-th part of a partition's rows, there are at most HOT_SHARE * partitions of them, whatever the data.
    """
    rows, most = right.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_LEAST, (rows or 0) // (HOT_SHARE * shuffle_partitions(left.sparkSession)))
    if (most or 0) <= least:
        return left.join(right, key)
    hot, cold = right.where(F.col(size) > least), right.where(F.col(size) <= least)
    found = left.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left").withColumn("_hot", F.col("_hot").isNotNull())
    return found.where("_hot").drop("_hot").join(F.broadcast(hot), key).unionByName(found.where("NOT _hot").drop("_hot").join(cold, key))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The strings of a column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def training_sample(rows: DataFrame, docs: DataFrame, label: str, per_class: int, seed: int, most: int | None = None) -> tuple[list, dict]:
    """(text, label) of at most per_class rows of each label value, and how many rows each value has.

    rows has doc_id and the label; docs has doc_id and text. If most is given, the values share so many rows at most (but one
    of each). Rows are counted by value in one pass, picked in another by a hash of doc_id below a value's share and then by rank
    among those, so no sort sees all rows; their texts are fetched by a join with the picked ids, which are broadcast
    and no more than the bound. A doc_id with several labels counts for each; one with several texts has the least of them.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return [], counts
    n = min(per_class, max(1, (most or per_class * len(counts)) // len(counts)))
    whole = 1 << 40
    limits = [(y, min(whole, int(whole * (n + 8 * n**0.5 + 8) / c))) for y, c in counts.items()]
    shares = spark.createDataFrame(limits, StructType([rows.schema["y"], *StructType.fromDDL("below long").fields]))
    at = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(whole))
    near = rows.withColumn("at", at).join(F.broadcast(shares), "y").where("at < below").select("doc_id", "y", "at").distinct()
    rank = F.row_number().over(Window.partitionBy("y").orderBy("at", "doc_id"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= n).select("doc_id", "y")
    picked = spark.createDataFrame(picked.toArrow(), picked.schema)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return [(r.text, r.y) for r in sorted(found.collect(), key=lambda r: (r.doc_id, str(r.y)))], counts


def carried(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names) and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))


def passed(batch: pa.RecordBatch, used: tuple[str, ...]) -> tuple[list[pa.Array], list[str]]:
    """The columns of a batch that are not used up, and their names."""
    names = [c for c in batch.schema.names if c not in used]
    return [batch.column(c) for c in names], names


def extended(df: DataFrame, used: tuple[str, ...], fields: str) -> StructType:
    """The columns of df that are not used up, and more fields (as DDL)."""
    return StructType([f for f in df.schema.fields if f.name not in used] + StructType.fromDDL(fields).fields)
