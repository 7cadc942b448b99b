"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark at once, over words.

The patterns are the distinct word windows of the benchmark. For each length among them: a shift table says for a block of
two words (by a hash, equal ones sharing the smaller value) how far the search may skip, its smallest distance to the end of
a pattern; where it may not skip, the hash of the block leads to the bucket of patterns that end so, a hash of the whole window
to those in it that may be equal, and these are compared word for word. But for the vocabulary all tables are arrays, of about 50
bytes for a word of the benchmark.

Size: a benchmark of at most BLOCK_BYTES of text is one block, whose tables are sent along with the one pass over the documents.
A larger one is cut into blocks of about that size (a single item is never cut) and the documents are read once for each, so
driver and workers hold one block at a time; what a block finds is kept by a digest of the text, for texts with hits only, and
joined at the end. The documents are not shuffled but by that last join.

Defined cases: null texts and texts without words hit nothing and are no patterns; items with the same text are counted
each, rows with the same item_id once; a null item_id takes part in hits but is not listed. Rows are returned one for one, with
repeated or null ids as they are; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import carried, checkpointed, extended, load, passed, texts

WINDOW = 10
BLOCK_BYTES = 8 << 20

_WORD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case; words of letters and digits of ASCII and of all other characters."""
    return text.translate(_WORD).split() if text else []


_ODD = 0x9E3779B97F4A7C15


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers."""
    h = h.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_ODD)
        out += h[i : i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Table:
    """The patterns of one length: shift table, buckets by the hash of the last block, windows in them, owners of windows."""

    def __init__(self, length: int, h: np.ndarray, starts: np.ndarray, items: np.ndarray) -> None:
        self.length, self.block = length, min(2, length)
        blocks = _rolled(h, self.block)
        bits = min(24, max(12, int(len(starts)).bit_length() + 4))
        self.down = np.uint64(64 - bits)
        far = length - self.block + 1
        self.shift = np.full(1 << bits, far, np.uint8)
        for end in range(self.block, length + 1):  # smaller shifts last
            self.shift[(blocks[starts + end - self.block] >> self.down).astype(np.int64)] = length - end
        suffix, whole = blocks[starts + length - self.block], _rolled(h, length)[starts]
        order = np.lexsort((starts, whole, suffix))
        suffix, whole, starts, items = suffix[order], whole[order], starts[order], items[order]
        # Windows with equal hashes are one pattern if their words are equal; the rest, if any, are patterns of their own.
        number = np.zeros(len(starts), np.int64)
        first, seen = -1, {}
        same = np.append(False, (suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])).tolist()
        at = starts.tolist()
        for i, again in enumerate(same):
            if not again:
                first, seen = i, {}
                number[i] = i
            else:
                seen = seen or {h[at[first] : at[first] + length].tobytes(): first}
                number[i] = seen.setdefault(h[at[i] : at[i] + length].tobytes(), i)
        order = np.lexsort((items, number))
        number, owners = number[order], items[order]
        new = np.append(True, number[1:] != number[:-1]) if len(number) else np.zeros(0, bool)
        places = number[new]
        self.suffix, self.whole, self.start = suffix[places], whole[places], starts[places].astype(np.int32)
        # Which hashes of whole windows there are, by their first bits.
        self.sifted = np.zeros(1 << bits, bool)
        self.sifted[(self.whole >> self.down).astype(np.int64)] = True
        self.owners, self.cuts = owners, np.append(np.flatnonzero(new), len(owners)).astype(np.int32)
        new = np.append(True, self.suffix[1:] != self.suffix[:-1]) if len(places) else np.zeros(0, bool)
        self.buckets, self.ranges = self.suffix[new], np.append(np.flatnonzero(new), len(places)).astype(np.int32)
        del self.suffix

    def ends(self, blocks: np.ndarray) -> list[int]:
        """Starts of windows that may be patterns: those at whose end the shift table allows no skip."""
        shift = self.shift[(blocks >> self.down).astype(np.int64)].tobytes()
        found, at, n = [], self.length - self.block, len(shift)
        while at < n:
            step = shift[at]
            if not step:
                found.append(at - self.length + self.block)
                step = 1
            at += step
        return found


class Patterns:
    """The tables for one block of items. Words are numbers of the block's vocabulary, 0 for all others, so equal numbers are equal words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.items = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)} | {None: -1}
        self.known: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        starts: dict[int, list[np.ndarray]] = {}
        of: dict[int, list[np.ndarray]] = {}
        n = 0
        for item, text in items:
            ids = np.array([self.known.setdefault(w, len(self.known) + 1) for w in item_words(text)], np.int32)
            if len(ids):
                m = min(window, len(ids))
                starts.setdefault(m, []).append(np.arange(n, n + len(ids) - m + 1))
                of.setdefault(m, []).append(np.full(len(ids) - m + 1, number[item], np.int32))
                flat.append(ids)
                n += len(ids)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.tables = [Table(m, self.flat, np.concatenate(starts[m]), np.concatenate(of[m])) for m in sorted(starts)]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of the occurrences, and the ids of the items that have one."""
        spans, items = [], set()
        h = np.fromiter(map(self.known.get, words, repeat(0)), np.int32, len(words))
        blocks = {k: _rolled(h, k) for k in {t.block for t in self.tables} if len(h) >= k}
        for t in self.tables:
            m = t.length
            if len(words) < m:
                continue
            places = np.array(t.ends(blocks[t.block]), np.int64)
            if not len(places):
                continue
            last = blocks[t.block][places + m - t.block]
            bucket = np.minimum(np.searchsorted(t.buckets, last), len(t.buckets) - 1)
            hit = t.buckets[bucket] == last
            places, bucket = places[hit], bucket[hit]
            wholes = _rolled(h[places[:, None] + np.arange(m)].T, m)[0]
            maybe = t.sifted[(wholes >> t.down).astype(np.int64)]
            for at, k, whole in zip(places[maybe].tolist(), bucket[maybe].tolist(), wholes[maybe], strict=True):
                a, b = t.ranges[k], t.ranges[k + 1]
                for p in range(a + np.searchsorted(t.whole[a:b], whole), b):
                    if t.whole[p] != whole:
                        break
                    if np.array_equal(self.flat[t.start[p] : t.start[p] + m], h[at : at + m]):
                        spans.append((at, at + m))
                        items.update(t.owners[t.cuts[p] : t.cuts[p + 1]].tolist())
        return spans, {self.items[k] for k in items if k >= 0}


_LAST = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans binary"
_FOUND = "digest string, spans binary, items array<string>"


def _counted(batch: pa.RecordBatch, used: tuple[str, ...], found: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
    """The other columns of a batch and the marks, from (words, spans, sorted items) of each row."""
    rows = []
    for n, pairs, items in found:
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 1], -1)
        hit = int((np.cumsum(edges) > 0).sum())
        rows.append((n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, pairs.astype("<i4").tobytes()))
    columns, names = passed(batch, used)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, [*names, *_LAST])


def _mark(patterns: Patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in texts(batch):
                words = item_words(t)
                spans, items = patterns.search(words)
                found.append((len(words), np.array(spans, np.int64).reshape(-1, 2), sorted(items)))
            yield _counted(batch, ("text",), found)

    return run


def _find(patterns: Patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, t in zip(batch.column("digest").to_pylist(), texts(batch), strict=True):
                spans, items = patterns.search(item_words(t))
                if spans:
                    rows.append((digest, np.array(spans, "<i4").tobytes(), sorted(items)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.list_(pa.string())))], ["digest", "spans", "items"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what the blocks found (lists of spans and of items) to the marks."""
    for batch in batches:
        found = []
        for t, spans, items in zip(texts(batch), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in spans]).astype(np.int64) if spans else np.zeros((0, 2), np.int64)
            found.append((len(item_words(t)), pairs, sorted({x for part in items or () for x in part})))
        yield _counted(batch, ("text", "digest", "spans", "items"), found)


def mark(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of rows but text, then n_words, n_hit, n_items, items_sha256, contaminated, spans (pairs of 32-bit word positions)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))

    def block(k: int) -> Patterns:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        return Patterns([(r.item_id, r.text.encode()) for r in part.toLocalIterator()], window)

    if blocks == 1:
        return rows.mapInArrow(_mark(block(0)), extended(rows, ("text",), _FIELDS))
    # Rows without a text get a digest of their own, so that they do not meet in one task.
    rows = rows.withColumn("digest", F.coalesce(F.sha2("text", 256), F.concat(F.lit("none-"), F.monotonically_increasing_id())))
    found = None
    for k in range(blocks):
        part = checkpointed(rows.where("text IS NOT NULL").select("digest", "text").mapInArrow(_find(block(k)), _FOUND).dropDuplicates(["digest"]))
        found = part if found is None else found.unionByName(part)
    marks = found.groupBy("digest").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    joined = rows.join(marks, "digest", "left")
    return joined.mapInArrow(_merge, extended(joined, ("text", "digest", "spans", "items"), _FIELDS))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the marks for each row of docs(doc_id, text); benchmark has item_id and text."""
    return mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, block_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs(text, and any other columns) that hold no window of the benchmark."""
    return mark(carried(docs), benchmark, window).where("NOT contaminated").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return find_benchmark(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
win AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM win JOIN p USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
