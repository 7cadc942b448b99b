"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of hashed word shingles, one permutation of which fills BINS bins; an empty bin copies a full
   one, chosen by a hash of the bin and the attempt, alike for all texts. The first BANDED bins are joined to BANDS bands.
2. Rows with the same set are one class (found by a digest of the set), represented by its smallest doc_id; from here on
   there are representatives only, so copies never multiply.
3. Each member of a bucket is linked to its HUBS hubs only (the smallest doc_id, then others by hashes), so a
   bucket of n members makes fewer than HUBS * n candidate edges; a text has a hub in each of its up to BANDS buckets. Edges
   whose parity sketches differ too much for the threshold are left out, the rest is confirmed on the full sets, and gives components.
4. What the stars leave: texts of buckets in which there are different components afterwards. A shingle that no other such
   text has is in no intersection with one; with u such shingles of n in each text the similarity of two is at most
   min(n - u) / (u + u' + max(n - u)). Texts that can reach the threshold with none go. In each bucket the text with the smallest
   share of such shingles, the one that most was copied from, is a second hub: the others are linked to it as before.
5. Members of a bucket that even then are in different components are compared with each other under two exact tests, that of
   sketches and the bound above; a pair is taken in the smallest key that its bands share, so once. Pairs that pass are confirmed
   on the full sets, so no link is lost to the choice of hubs. Texts that were edited apart fail the tests at once.

Hot keys (a bucket, or a group of copies, of more than a small part of all rows) are joined by broadcast, so that their rows stay
where they are; everything else about a bucket is aggregated before it is shuffled.

A parity sketch has SKETCH bits, each the parity of the number of hashes of the set that fall on it. The sketches of two sets
differ in at most as many bits as the sets differ in hashes, so a pair at the threshold or above is never left out, whatever
its sizes: the test is exact. It tells little of sets of more than some 2,300 hashes, whose pairs all are confirmed in full.
Only the bands can miss a pair, at the threshold of 0.8 with probability (1 - 0.8 ** 4) ** 32 = 5e-8.

Defined cases: texts without words or null have an empty set and are linked with nothing, not even with each other; texts of
fewer words than a shingle have one shingle, all their words. Rows that share a doc_id are one
node: what one of them is linked with, all are. Rows without doc_id are left out, as a component is named by one. Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import LOWER, checkpointed, joined_by_size, load, texts
from palisade.llm.components import connected

SHINGLE, PERCENT = 4, 80
#: Bins of a signature; those of them that bands are made of; bins in a band.
BINS, BANDED, ROWS = 256, 128, 4
BANDS = BANDED // ROWS
#: Bits of a parity sketch, and its 64-bit words.
SKETCH = 1024
WORDS = SKETCH // 64
HUBS = 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z in lower case."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = _mix(out * _ODD + h[i : i + n])
    return np.unique(_mix(out))


#: For each empty bin, the bins to copy from, in order of the attempts; the last column ends every search.
_TRIES = 24
_FROM = (_mix(np.arange(BINS * _TRIES, dtype=np.uint64) + np.uint64(12345)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _TRIES)


def signature(found: np.ndarray) -> np.ndarray:
    """One value for each bin of a non-empty set; empty bins copy others (optimal densification)."""
    h = _mix(found + _ODD)
    bins = (h >> np.uint64(56)).astype(np.int64)  # of BINS
    order = np.lexsort((h, bins))
    first = np.flatnonzero(np.append(True, bins[order][1:] != bins[order][:-1]))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    where = order[first]
    out[bins[where]] = h[where]
    full[bins[where]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[_FROM[empty]]
        some = hit.any(1)
        source = _FROM[empty, hit.argmax(1)]
        left = np.flatnonzero(~some)
        if len(left):  # few full bins: take the one whose mixed number with that of the empty bin is least
            there = np.flatnonzero(full)
            source[left] = there[_mix(empty[left].astype(np.uint64)[:, None] * np.uint64(1009) + there.astype(np.uint64)[None, :]).argmin(1)]
        out[empty] = out[source]
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, from its number and its bins."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in sig[:BANDED].reshape(BANDS, ROWS).T:
        out = _mix(out * _ODD + part)
    return out


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes on each of SKETCH bits, as 64-bit words."""
    at = (_mix(found ^ _ODD) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).view(np.uint64)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands, sketches = [], [], [], []
            for t in texts(batch):
                s = shingles(t, k)
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(bands_of(signature(s)).view(np.int64))
                sketches.append(sketch(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(t, k).tobytes() for t in texts(batch)], pa.binary())], ["rep", "hashes"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ha"), batch.column("hb"), strict=True):
                if a != last:
                    last, left = a, np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                total = len(left) + len(right)
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    keep.append(False)
                    continue
                both = np.concatenate([left, right])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (total - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, hash) for every hash of every set."""
    for batch in batches:
        for rep, x in zip(batch.column("rep").to_pylist(), batch.column("hashes"), strict=True):
            found = np.frombuffer(x.as_buffer(), np.int64)
            for i in range(0, len(found), 100_000):
                part = found[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rep), pa.int64()), pa.array(part)], ["rep", "hash"])


def _alike(x, y, total, percent: int):
    """Whether two sets of total hashes together can reach the threshold: they differ in no fewer hashes than their sketches in bits."""
    bits = None
    for i in range(WORDS):
        z = F.bit_count(x[i].bitwiseXOR(y[i]))
        bits = z if bits is None else bits + z
    return F.lit(100 + percent) * bits <= F.lit(100 - percent) * total


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band values, parity sketch; for rows of docs(doc_id, text) that have an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(_sign(k), _SIGNED)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text) that has an id."""
    signed = checkpointed(signatures(docs, k))
    classes = checkpointed(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    keys = classes.select("rep", F.explode("bands").alias("key"))
    hubs = F.array_distinct(F.array(F.min("rep"), *(F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(1, HUBS))))
    buckets = checkpointed(keys.groupBy("key").agg(F.count("*").alias("size"), hubs.alias("hubs")).where("size > 1"))
    members = checkpointed(joined_by_size(keys, buckets, "key"))

    def sifted(pairs: DataFrame) -> DataFrame:
        a, b = (classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(_alike(F.col("sa"), F.col("sb"), F.col("na") + F.col("nb"), percent)).select("a", "b")

    star = members.select("rep", F.explode("hubs").alias("hub")).where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    edges = checkpointed(sifted(star))
    # Buckets of which the stars have not compared all pairs.
    open_ = members.where(F.col("size") > F.size("hubs") + 1).select("key", "rep")
    needed = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).union(open_.select("rep")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    hashes = checkpointed(rows.mapInArrow(_sets(k), "rep long, hashes binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = hashes.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), hashes.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"))
        return checkpointed(pairs.join(a, "a").join(b, "b").select("a", "ha", "b", "hb").mapInArrow(_confirm(percent), "a long, b long"))

    links = confirmed(edges)
    labels = connected(links)
    at = open_.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    apart = checkpointed(_mixed(checkpointed(at)))
    if not apart.isEmpty():
        own = _unshared(hashes, apart)
        facts = classes.select("rep", "n", "sketch", "bands").join(apart.select("rep").distinct(), "rep", "left_semi").join(own, "rep", "left").withColumn("u", F.coalesce("u", F.lit(0))).withColumn("rest", F.col("n") - F.col("u"))
        facts = checkpointed(facts.where(F.lit(100) * F.col("rest") >= F.lit(percent) * F.col("n")))
        sides = checkpointed(apart.join(facts.select("rep", "n", "u"), "rep"))
        central = sides.groupBy("key").agg(F.min_by("rep", F.struct(F.col("u") / F.col("n"), F.col("rep"))).alias("hub"), F.count("*").alias("size"))
        second = joined_by_size(sides.select("rep", "label", "key"), checkpointed(central), "key").where("rep <> hub")
        at_hub = apart.select(F.col("rep").alias("hub"), F.col("label").alias("hub_label")).distinct()
        second = second.select("rep", "label", "hub").distinct().join(at_hub, "hub").where("label <> hub_label")
        found = confirmed(sifted(second.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = connected(links)
            sides = sides.drop("label").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        still = checkpointed(_mixed(sides.select("key", "rep", "label")))
        sides = checkpointed(still.join(facts, "rep"))
        m, o = sides.alias("m"), sides.alias("o")
        possible = F.lit(100) * F.least("m.rest", "o.rest") >= F.lit(percent) * (F.col("m.u") + F.col("o.u") + F.greatest("m.rest", "o.rest"))
        first = F.array_min(F.array_intersect("m.bands", "o.bands")) == F.col("m.key")
        alike = _alike(F.col("m.sketch"), F.col("o.sketch"), F.col("m.n") + F.col("o.n"), percent)
        pairs = m.join(o, (F.col("m.key") == F.col("o.key")) & (F.col("m.rep") < F.col("o.rep")) & (F.col("m.label") != F.col("o.label")) & possible & alike & first)
        found = confirmed(pairs.select(F.col("m.rep").alias("a"), F.col("o.rep").alias("b")).distinct())
        if not found.isEmpty():
            labels = connected(links.unionByName(found))
    named = checkpointed(classes.select("digest", "size", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "size", F.coalesce("component", "rep").alias("component_id")))
    full = joined_by_size(signed.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest"), named, "digest").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _mixed(members: DataFrame) -> DataFrame:
    """key, rep, label of buckets with different labels."""
    mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    return joined_by_size(members, checkpointed(mixed), "key").select("key", "rep", "label")


def _unshared(hashes: DataFrame, apart: DataFrame) -> DataFrame:
    """rep, u: how many shingles of each text no other text of apart has."""
    owned = hashes.join(apart.select("rep").distinct(), "rep", "left_semi").mapInArrow(_single, "rep long, hash long")
    return owned.groupBy("hash").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("u"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, and any other columns) without those whose component has a smaller doc_id; rows without doc_id stay."""
    late = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_late")).distinct()
    return docs.join(late, docs["doc_id"].cast("long") == late["_late"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
