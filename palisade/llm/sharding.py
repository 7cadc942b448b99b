"""Sharding: a lookup table of prime size, filled by permutations.

Each shard has its own order of preference over the slots, (offset + i * skip) mod SLOTS with offset and skip from hashes of
its name; as SLOTS is prime, that runs through all of them. Shards take turns claiming their next free slot until the table
is full, so each gets as many slots as any other, to within one, and few slots change hands when a shard comes or goes.
A document's slot is a hash of its doc_id modulo SLOTS; the table is broadcast (SLOTS rows, whatever the data), so placing
is one lookup without a shuffle.

Defined cases: rows that share a doc_id go to the same shard; a null doc_id is hashed as "". Text and other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import load

SHARDS, SLOTS = tuple(f"shard-{i:03d}" for i in range(40)), 4099


def lookup(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot; slots is a prime of at least the number of shards."""
    if not shards or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is no less than the number of shards, and there must be one")

    def number(name: str, salt: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")

    order = [(number(s, "offset") % slots, number(s, "skip") % (slots - 1) + 1) for s in shards]
    table, turn, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for k, (offset, skip) in enumerate(order):
            while table[slot := (offset + turn[k] * skip) % slots] >= 0:
                turn[k] += 1
            table[slot] = k
            free -= 1
            if not free:
                break
    return table


def slot(doc_id: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") % slots).cast("int")


def placed(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All columns of docs(doc_id, ...) as struct row, then slot and shard."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup(shards, slots))), "slot int, number int")
    names = spark.createDataFrame(list(enumerate(shards)), "number int, shard string")
    table = table.join(F.broadcast(names), "number").select("slot", "shard")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), slot(F.col("doc_id"), slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("row", "slot", "shard")


def sharded(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The columns of docs and shard; a column of docs by that name gives way to it."""
    rows = placed(docs.drop("shard"), shards, slots)
    return rows.select("row.*", "shard")


def write(docs: DataFrame, path: str, shards: tuple[str, ...] = SHARDS) -> None:
    """docs as Parquet under path, a folder for each shard."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return placed(load(spark, sf_dir, "documents").select("doc_id")).select("row.doc_id", "slot", "shard")


def SQL() -> str:  # noqa: N802
    return f"""
WITH t AS (SELECT [{", ".join(map(str, lookup()))}] AS owner, [{", ".join(f"'{s}'" for s in SHARDS)}] AS name),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, name[owner[slot + 1] + 1] AS shard FROM d, t
"""
