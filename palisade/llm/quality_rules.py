"""Quality rules: repetition inside a document by its suffix array.

The words of many documents at a time become one array of suffix ranks by prefix doubling (ranks start from document and
word, so suffixes of different documents never mix, and after each round only suffixes that are still equal to another
one are ranked further). Neighbours in that order share the longest common prefixes. An interval of the order whose suffixes
share l words, and no larger interval does, is a repeat that no word to the right extends; if the words before its suffixes differ,
none to the left does either, and it is a maximal repeated substring. The spans of those of at least MIN_REPEAT words are united;
the covered fraction of the words and the longest repeat are limited.

Each row stands alone: no shuffle, and no state but that of a chunk of rows, which holds at least one whole text.

Defined cases: null and empty texts have zeros everywhere and fail the base rules (fewer than 10 words); a repeat may
overlap itself, so "a a a" repeats "a a". Rows are returned one for one, with repeated or null ids as they are; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.common import WHITE, load, texts

#: Base rules: fewest words, and percent of words in repeated 5-word windows.
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: Suffix-array rules: a repeat counts from so many words; percent of words covered; words of the longest one.
MIN_REPEAT, MAX_PERCENT, MAX_LONGEST = 8, 15, 60
CHUNK_WORDS = 300_000

_NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents laid end to end: suffix array, and the common prefix of each suffix with the next one in it.

    ids: a number for each word; ends: for each word, where its document ends. Suffixes of different documents share nothing.
    """
    n = len(ids)
    order = np.lexsort((ids, ends))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (ends[order][1:] != ends[order][:-1]))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [rank], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        after = tied + k
        key = np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((key, rank[tied]))
        tied, key = tied[order], key[order]
        old = rank[tied]
        in_class = np.append(True, old[1:] != old[:-1])
        in_group = in_class | np.append(True, key[1:] != key[:-1])
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(in_group, at, 0))
        fresh = old + group - np.maximum.accumulate(np.where(in_class, at, 0))
        rank = rank.copy()
        rank[tied] = fresh
        levels.append(rank)
        k *= 2
        alone = in_group & np.append(in_group[1:], True)
        tied = tied[~alone]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        level = levels[power]
        common += (inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])).astype(np.int64) << power
    return suffixes, common


def intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Intervals of suffixes that share at least so many words: length, first and last place, parent (or -1), and by pair of neighbours that share so many the narrowest interval of both (else -1)."""
    length, left, right, parent = [], [], [], []
    of_pair = np.full(len(common), -1, np.int64)
    places = np.flatnonzero(common >= least)
    narrowest, stack, before = [], [], -2

    def close(place: int) -> None:
        while stack:
            i = stack.pop()
            right[i] = place
            parent[i] = stack[-1] if stack else -1

    for place, shared in zip(places.tolist(), common[places].tolist(), strict=True):
        if place != before + 1:
            close(before + 1)
        begin, child = place, -1
        while stack and length[stack[-1]] > shared:
            i = stack.pop()
            right[i], begin = place, left[i]
            if stack and length[stack[-1]] >= shared:
                parent[i] = stack[-1]
            else:
                child = i
        if not stack or length[stack[-1]] < shared:
            stack.append(len(length))
            length.append(shared), left.append(begin), right.append(-1), parent.append(-1)
            if child >= 0:
                parent[child] = stack[-1]
        narrowest.append(stack[-1])
        before = place
    close(before + 1)
    of_pair[places] = narrowest
    return np.array(length, np.int64), np.array(left, np.int64), np.array(right, np.int64), np.array(parent, np.int64), of_pair


def maximal_repeats(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By position: words of the longest maximal repeat of at least so many words that begins there; and of the longest repeat of any length that does."""
    n = len(ids)
    suffixes, common = suffix_array(ids, ends)
    any_ = np.zeros(n, np.int64)
    any_[suffixes[:-1]] = common
    np.maximum.at(any_, suffixes[1:], common)
    length, left, right, parent, of_pair = intervals(common, least)
    found = np.zeros(n, np.int64)
    if len(length):
        first = np.append(True, ends[1:] != ends[:-1])
        word_before = np.where(first, -1 - np.arange(n), np.append(-1, ids[:-1]))[suffixes]
        changes = np.append(0, np.cumsum(word_before[1:] != word_before[:-1]))
        maximal = (changes[right] > changes[left]).tolist()
        value = length.tolist()
        up = parent.tolist()
        for i in np.argsort(length, kind="stable").tolist():
            if not maximal[i]:
                value[i] = value[up[i]] if up[i] >= 0 else 0
        pair = np.where(of_pair >= 0, np.array(value, np.int64)[of_pair], 0)
        found[suffixes[:-1]] = pair
        np.maximum.at(found, suffixes[1:], pair)
    return found, any_


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in the span of a repeat of at least so many words."""
    at = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, at + longest, 0)) > at


def _chunk(words: list[list[bytes]]) -> tuple[list[int], list[int], list[int]]:
    """By document: words in repeated 5-word windows, words in repeats, words of the longest repeat."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(counts)
    if not len(counts) or not stops[-1]:
        return [0] * len(words), [0] * len(words), [0] * len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(stops[-1]))
    maximal, longest = maximal_repeats(ids, np.repeat(stops, counts), BASE_WINDOW)
    full = np.flatnonzero(counts)
    firsts = (stops - counts)[full]
    out = []
    for values, reduce in ((_covered(maximal, BASE_WINDOW).astype(np.int64), np.add), (_covered(maximal, MIN_REPEAT).astype(np.int64), np.add), (longest, np.maximum)):
        column = np.zeros(len(words), np.int64)
        column[full] = reduce.reduceat(values, firsts)
        out.append(column.tolist())
    return tuple(out)


_FIELDS = [("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered", pa.int64()), ("longest_repeat", pa.int64())]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[tuple], words: list[list[bytes]]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in _FIELDS]
        for (i, n, chars, symbols, lines), repeat, covered, longest in zip(rows, *_chunk(words), strict=True):
            failed = n < MIN_WORDS or 100 * repeat > BASE_PERCENT * n
            kept = not failed and 100 * covered <= MAX_PERCENT * n and longest <= MAX_LONGEST
            for column, value in zip(columns, (i, n, chars, symbols, lines, repeat, failed, kept, covered, longest), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [x for x, _ in _FIELDS])

    rows: list[tuple] = []
    words: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            t = t or b""
            w = t.split()
            lines = [x for x in t.split(b"\n") if x.strip()]
            rows.append((i, len(w), len(t.translate(None, _NOT_COUNTED)), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines))))
            words.append(w)
            size += len(w)
            if size >= CHUNK_WORDS or len(rows) >= 10_000:
                yield emit(rows, words)
                rows, words, size = [], [], 0
    if rows:
        yield emit(rows, words)


def judge(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for each row of docs(doc_id, text)."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents")).drop("longest_repeat")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (5), (8), (61)) AS s(k) WHERE len(ws) >= k)),
again AS (SELECT doc_id, k, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) FILTER (WHERE k = 5) AS r5, count(DISTINCT p) FILTER (WHERE k = 8) AS r8, bool_or(k = 61) AS far FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r5, 0) AS BIGINT) AS n_repeat_words, coalesce(r8, 0) AS r8, coalesce(far, false) AS far
 FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * r8 <= 15 * n_words AND NOT far AS kept, CAST(r8 AS BIGINT) AS n_covered FROM b
"""
