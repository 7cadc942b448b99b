"""Connected components of a distributed edge list, by alternating large and small stars while there are many edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import checkpointed

#: Rounds after which the search gives up; it takes about the square of the logarithm of the longest path at most.
MOST_ROUNDS = 60
#: Up to so many edges (16 bytes each) are settled by one task; a round of stars takes some ten shuffles, whatever their number.
FEW = 1 << 18


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))).first())


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, component of all ids in the edges(u, v) of one task: roots hang on the smallest root that an edge leads to, until none does."""
    ends = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*ends, strict=True) if ends else ((), ())))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], ["id", "component"])


def connected(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id in links(a, b), which are long.

    Each round hangs the larger neighbours of a node on its smallest neighbour (large star), then all of its smaller ones
    and itself (small star), until every node hangs on its root. Both work by groupBy and join, so no neighbourhood is
    collected into one row. Links stay as many as they were at most; once they are FEW, one task settles what is left.
    """
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if state[0] <= FEW:
            return checkpointed(edges.coalesce(1).mapInArrow(_settled, "id long, component long"))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u AND v <> low").select(F.col("low").alias("u"), "v")
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("low").alias("u"), "v"), F.struct(F.col("low").alias("u"), F.col("u").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("u <> v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = edges.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return checkpointed(stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct())
