"""Substring dedup: windows of words that start earlier elsewhere are cut out.

Every document is cut into super-k-mers: runs of consecutive windows whose smallest m-word hash (the minimiser) is the
same. A super-k-mer travels once, as one packed string, to the bucket of its minimiser; equal windows have equal
minimisers, so they meet there, where they are sorted by hash and compared byte for byte.

Skew: a map task sends a super-k-mer that it sees again only once and settles the repeats itself, so a passage that a third
of all rows share arrives once per chunk of a map task, not once per row. Buckets are many and small; a reduce task
loads them one after the other. Of a bucket of more than BUCKET_MOST bytes it reads the strings one at a time and passes their windows
on, as a 128-bit hash, document and start; these are dealt by hash over all tasks and sorted there, so a minimiser that very many
different texts share costs its own task one reading and nothing more. A map task remembers what it has sent, up to SEEN strings.

Defined cases: a null or empty text has no words; a text shorter than the window keeps all of them. Rows that share a
doc_id count as one document (a window at the same start in two of them is not earlier in either). A row without doc_id
is returned as it is and is no earlier occurrence of anything. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import plan_bytes, shuffle_partitions, texts

#: Words in a window, and words in the pieces among which a window's minimiser is sought.
WINDOW, PIECE = 20, 4
#: Words handled at a time by a map task; bytes that it gathers before it sends; packed bytes that a reduce task loads at a time.
CHUNK_WORDS, SEND_BYTES, LOAD_BYTES = 300_000, 24 << 20, 8 << 20
#: Bytes of a bucket that are settled at once; strings that a map task remembers.
BUCKET_MOST, SEEN = 24 << 20, 100_000
#: A bucket gets about so many packed bytes; the packed strings are about so many times the stored input.
BUCKET_BYTES, GROWTH = 4 << 20, 6

_PACKED = "bucket int, doc_id long, size long, packed binary, meta binary"
_SPANS = "doc_id long, spans binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values of h, by doubling."""
    out, done, power = None, 0, 0
    part, factor = h, 0x100000001B3D5 | 1
    while k >> power:
        if k >> power & 1:
            if out is None:
                out, done = part, 1 << power
            else:
                n = len(h) - done - (1 << power) + 1
                out = out[:n] * np.uint64(pow(factor, 1 << power, 1 << 64)) + part[done : done + n]
                done += 1 << power
        n = len(h) - (2 << power) + 1
        if n <= 0:
            break
        part = part[:n] * np.uint64(pow(factor, 1 << power, 1 << 64)) + part[1 << power : (1 << power) + n]
        power += 1
    return _mix(out)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(starts: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, bytes]]:
    """(doc_id, spans) from windows sorted by id and start; a span is a pair of 32-bit word positions."""
    if not len(ids):
        return
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    pairs = np.stack([starts[first], starts[last] + k], 1).astype("<i4")
    of = ids[first]
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(of)), strict=True):
        yield int(of[a]), pairs[a:b].tobytes()


def _pack(buckets: int, k: int, m: int):
    """Documents to packed super-k-mers by bucket, and the spans that a chunk settles itself (those have no packed string)."""

    def chunk(ids: list[int], words: list[list[bytes]], out: dict, settled: list, sent: dict) -> int:
        order = np.argsort(np.asarray(ids, np.int64), kind="stable")
        ids, words = np.asarray(ids, np.int64)[order], [words[i] for i in order]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if len(flat) < k:
            return 0
        h = _hashes(flat)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        buffer = b" ".join(flat)
        doc = np.repeat(np.arange(len(words)), counts)
        first = np.cumsum(counts) - counts
        least = _least(_rolled(h, m), k - m + 1)
        valid = np.flatnonzero(doc[: len(least)] == doc[k - 1 :])
        if not len(valid):
            return 0
        low = least[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        a = valid[at]
        b = valid[np.append(at[1:], len(valid)) - 1]
        from_ = np.where(a > 0, ends[a - 1] + 1, 0).tolist()
        to = ends[b + k - 1].tolist()
        bucket = (_mix(low[at]) % np.uint64(buckets)).astype(np.int64).tolist()
        of, begin, last = ids[doc[a]].tolist(), (a - first[doc[a]]).tolist(), (b - first[doc[b]]).tolist()
        size = 0
        for x, y, z, i, s, e in zip(from_, to, bucket, of, begin, last, strict=True):
            piece = buffer[x:y]
            digest = xxhash.xxh3_128_digest(piece)
            got = sent.get(digest)
            if got is None or (i, s) <= got:
                if got is not None or len(sent) < SEEN:
                    sent[digest] = (i, s)
                row = out.setdefault(z, ([], [], []))
                row[0].append(piece)
                row[1].append(i)
                row[2].append(s)
                size += y - x + 60
            else:
                settled.append((i, s, e))
        return size

    def send(out: dict, settled: list, pack) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        for z, (pieces, ids, starts) in out.items():
            text = b"\n".join(pieces)
            meta = np.asarray(ids, "<i8").tobytes() + np.asarray(starts, "<i4").tobytes()
            for column, value in zip(rows, (z, None, len(text), pack(text), pack(meta)), strict=True):
                column.append(value)
        if settled:
            s = np.array(settled, np.int64)
            s = s[np.lexsort((s[:, 1], s[:, 0]))]
            n = s[:, 2] - s[:, 1] + 1
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts, of = np.repeat(s[:, 1], n) + offset, np.repeat(s[:, 0], n)
            o = np.lexsort((starts, of))
            for i, spans in _runs(starts[o], of[o], k):
                for column, value in zip(rows, (i % buckets, i, 0, None, spans), strict=True):
                    column.append(value)
        out.clear()
        settled.clear()
        for x in range(0, len(rows[0]), 256):
            part = [c[x : x + 256] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "doc_id", "size", "packed", "meta"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        out: dict = {}
        settled: list = []
        sent: dict[bytes, tuple[int, int]] = {}
        ids: list[int] = []
        words: list[list[bytes]] = []
        n = size = 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                w = t.split() if t else []
                if len(w) < k:
                    continue
                ids.append(i)
                words.append(w)
                n += len(w)
                if n >= CHUNK_WORDS:
                    size += chunk(ids, words, out, settled, sent)
                    ids, words, n = [], [], 0
                    if size >= SEND_BYTES:
                        yield from send(out, settled, pack)
                        size = 0
        if ids:
            chunk(ids, words, out, settled, sent)
        yield from send(out, settled, pack)

    return run


def _windows(text: bytes, meta: bytes, k: int) -> tuple[np.ndarray, ...]:
    """hash, doc_id, start, and place in text (begin, end) of each window of a packed string."""
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = len(meta) // 12
    cuts = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
    counts = np.diff(np.searchsorted(ends, cuts, "right"), prepend=0)
    piece = np.repeat(np.arange(n), counts)
    first = np.cumsum(counts) - counts
    h = _rolled(_hashes(words), k)
    ok = np.flatnonzero(piece[: len(h)] == piece[k - 1 :])
    of = piece[ok]
    return h[ok], np.frombuffer(meta, "<i8", n)[of], np.frombuffer(meta, "<i4", n, 8 * n)[of] + (ok - first[of]), ends[ok] - lengths[ok], ends[ok + k - 1]


def _duplicates(packs: list[tuple[bytes, bytes]], k: int) -> Iterator[tuple[int, bytes]]:
    """Spans of the windows that start earlier elsewhere in these packed strings, which hold whole buckets."""
    unpack = zstandard.ZstdDecompressor().decompress
    kept = [unpack(p) for p, _ in packs]
    columns: list[list] = [[], [], [], [], [], []]
    for number, (text, (_, meta)) in enumerate(zip(kept, packs, strict=True)):
        found = _windows(text, unpack(meta), k)
        for column, value in zip(columns, (*found, np.full(len(found[0]), number)), strict=True):
            column.append(value)
    h, of, begin, x, y, number = map(np.concatenate, columns)
    del columns
    order = np.argsort(h)
    again = np.zeros(len(h), bool)
    again[1:] = h[order][1:] == h[order][:-1]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((begin[order], of[order], h[order]))]
    if not len(order):
        return
    h, of, begin, x, y, number = (c[order] for c in (h, of, begin, x, y, number))
    place = list(zip(number.tolist(), x.tolist(), y.tolist(), strict=True))

    def words(i: int) -> bytes:
        return kept[place[i][0]][place[i][1] : place[i][2]]

    new = np.append(True, h[1:] != h[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    differ, current = [], b""
    for i, is_new in enumerate(new.tolist()):
        if is_new:
            current = words(i)
        elif words(i) != current:
            differ.append(i)
    for g in set(lead[differ].tolist()):  # other texts with the same hash: tell the texts of this group apart
        by: dict[bytes, int] = {}
        for i in np.flatnonzero(lead == g).tolist():
            lead[i] = by.setdefault(words(i), i)
    late = (of != of[lead]) | (begin != begin[lead])
    of, begin = of[late], begin[late].astype(np.int64)
    o = np.lexsort((begin, of))
    yield from _runs(begin[o], of[o], k)


_SETTLED = "doc_id long, spans binary, hash binary, start int"


def _settle(k: int):
    """Packed strings, sorted by bucket, to spans; of large buckets to single windows with their hash."""

    def spans(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(rows), 10_000):
            part = rows[x : x + 10_000]
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), none.cast(pa.binary()), none.cast(pa.int32())], ["doc_id", "spans", "hash", "start"])

    def windows(packs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for packed, meta in packs:
            text = unpack(packed)
            _, of, begin, x, y = _windows(text, unpack(meta), k)
            for i in range(0, len(of), 100_000):
                part = slice(i, i + 100_000)
                hashes = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(x[part].tolist(), y[part].tolist(), strict=True)]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(of[part], pa.int64()), pa.nulls(n).cast(pa.binary()), pa.array(hashes, pa.binary()), pa.array(begin[part].astype(np.int32))], ["doc_id", "spans", "hash", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []  # whole buckets, and what there is of the current one
        size, current, mine, large = 0, None, 0, False
        for batch in batches:
            passed = []
            for b, i, n, packed, meta in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "size", "packed", "meta")), strict=True):
                if packed is None:
                    passed.append((i, meta))
                    continue
                if b != current:
                    if held and size >= LOAD_BYTES:
                        yield from spans(list(_duplicates(held, k)))
                        held, size = [], 0
                    current, mine, large = b, 0, False
                mine += n
                if large:
                    yield from windows([(packed, meta)])
                    continue
                held.append((packed, meta))
                size += n
                if mine > BUCKET_MOST:
                    # What is held of other buckets is below LOAD_BYTES; its windows go along.
                    yield from windows(held)
                    held, size, large = [], 0, True
            yield from spans(passed)
        if held:
            yield from spans(list(_duplicates(held, k)))

    return run


def _late(k: int):
    """Of windows sorted by hash, document and start, all but the first of each hash; spans pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, spans = [], []
            for i, s, h, start in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "spans", "hash", "start")), strict=True):
                if h is None:
                    ids.append(i), spans.append(s)
                    continue
                if last is None or h != last[0]:
                    last = (h, i, start)
                elif (i, start) != last[1:]:
                    ids.append(i), spans.append(np.array([start, start + k], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "spans"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for i, t, spans in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("spans").to_pylist(), strict=True):
            words = t.split() if t else []
            n = len(words)
            if spans:
                drop = np.zeros(n + 1, np.int64)
                for a, b in np.minimum(np.concatenate([np.frombuffer(s, "<i4").reshape(-1, 2) for s in spans]), n).tolist():
                    drop[a] += 1
                    drop[b] -= 1
                words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
            for column, value in zip(out, (i, n, n - len(words), b" ".join(words)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, spans (array of binary): the word spans of docs(doc_id, text) that windows starting earlier elsewhere cover.

    The spans of a document may overlap; each binary holds pairs of little-endian 32-bit word positions, end exclusive.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = plan_bytes(docs.select("text"))
    tasks = shuffle_partitions(spark)
    buckets = min(max(tasks, 8 * tasks if size is None else GROWTH * size // BUCKET_BYTES), 1 << 30)
    packed = rows.mapInArrow(_pack(buckets, window, piece), _PACKED)
    tasks = max(tasks, buckets // 32)
    settled = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(window), _SETTLED)
    late = settled.repartition(F.coalesce("hash", F.col("doc_id").cast("string").cast("binary"))).sortWithinPartitions("hash", "doc_id", "start").mapInArrow(_late(window), _SPANS)
    return late.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the words that stay, joined by one space) for each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows without doc_id have no spans; in the join they would all meet in one task.
    spans = rows.where("doc_id IS NOT NULL").join(repeated_spans(docs, window, piece), "doc_id", "left")
    alone = rows.where("doc_id IS NULL").withColumn("spans", F.lit(None).cast("array<binary>"))
    return spans.unionByName(alone).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    from palisade.llm.common import load

    out = dedup_substrings(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha256_hex(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
firsts AS (SELECT g, min(doc_id * 1000000000 + i) AS f FROM win GROUP BY g HAVING count(*) > 1),
dup AS (SELECT doc_id, i FROM win JOIN firsts USING (g) WHERE doc_id * 1000000000 + i > f),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM pos ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
