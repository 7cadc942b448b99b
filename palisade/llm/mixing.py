"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens (words) are counted over all documents by cell: source, language and topic. The cells are raked: in turn, their
weights are scaled to the target shares of sources, of languages and of topics, ROUNDS times, and after each round trimmed to TRIM
times their observed share, so that a rare cell cannot scale all others down. A cell's factor is its fitted
over its observed weight; the factors divided by the largest are the probabilities with which a cell's documents are kept.
A document is kept if a hash of its doc_id, as a number from 0 to 1, is below its probability: the same on every run. The largest
miss of a target share that is left (by trimming, or by targets that no weights meet) is measured and warned of above TOLERANCE.

A document's topic is the word of a fixed list that it has most often (the first one in the list, if several): the TOPICS words, of
LETTERS characters at least, that most documents have among those that at most one of COMMON has. The list is made from all documents; the SQL still
makes it from about SAMPLE of them, so that beyond SAMPLE documents its topics can be others. A document with none of them is of topic "other".

Targets are shares raised to a power below 1 and normalised, by default, or given by name; names without a target get a share
of 0 and their documents go; targets of names that no document has are shared out over the others.

Size: documents are read once to count them, once for the list (sums by word, combined before the shuffle, HELD words or SEEN
bytes of texts at a time), once to count tokens (sums by cell, combined before the shuffle) and once to sample; the table of cells goes to the driver and is broadcast, and is refused beyond MAX_CELLS cells.

Defined cases: a null source or language is one of its own, named ""; a text without words counts as one token, as topic
"empty"; a null doc_id is hashed as "". Rows are judged one for one; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import carried, extended, load, passed, texts

ROUNDS, TRIM, TOLERANCE, MAX_CELLS = 16, 2.0, 0.02, 500_000
TOPICS, SAMPLE, COMMON, LETTERS = 16, 5_000, 5, 4
#: Words, and bytes of the texts that they are from, whose counts a task holds before it sends them on.
HELD, SEEN = 100_000, 64 << 20
#: Power that tempers the observed shares to targets, by dimension.
POWERS = {"source": 0.85, "lang": 0.85, "topic": 0.9}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_NO_WORD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, A-Z in lower case."""
    return text.translate(_NO_WORD).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and in how many texts they are; a word can come several times, for parts of the texts."""

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts, seen = Counter(), 0
    for batch in batches:
        for t in texts(batch):
            counts.update({w for w in words(t) if len(w) >= LETTERS})
            seen += len(t or b"")
            if len(counts) > HELD or seen > SEEN:
                yield sent()
                counts, seen = Counter(), 0
    if counts:
        yield sent()


def anchors(docs: DataFrame) -> list[str]:
    """The words that name topics, from all texts of docs(doc_id, text)."""
    n = docs.count()
    found = docs.select("text").mapInArrow(_counted, "word string, n long").where(F.length("word") >= LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.where(F.col("n") * COMMON <= n).orderBy(F.desc("n"), "word").limit(TOPICS).collect()]


def topic(found: list[bytes], ranks: dict[bytes, int]) -> str:
    """The ranked word that is most often among the words found, the first one of several."""
    if not found:
        return "empty"
    hits = Counter(filter(ranks.__contains__, found))
    return min(hits, key=lambda w: (-hits[w], ranks[w])).decode() if hits else "other"


def _measure(names: list[str]):
    """Adds n_tokens and topic to rows with a text."""
    ranks = {w.encode(): i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, topics = [], []
            for t in texts(batch):
                found = words(t)
                tokens.append(max(len(found), 1))
                topics.append(topic(found, ranks))
            columns, kept = passed(batch, ("text",))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(topics, pa.string())], [*kept, "n_tokens", "topic"])

    return run


def measured(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of rows but text, then n_tokens and topic."""
    return rows.mapInArrow(_measure(names), extended(rows, ("text",), "n_tokens long, topic string"))


def unit(doc_id: Column) -> Column:
    """A number from 0 to 1 for an id: the first 52 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: list[tuple], weights: list[float], targets: list[dict], rounds: int = ROUNDS, trim: float = TRIM) -> tuple[np.ndarray, float]:
    """Weights of cells (a name in each dimension) fitted to the target shares of each dimension, and the largest miss of one."""
    observed = np.array(weights, float)
    observed = observed / observed.sum()
    w = observed.copy()
    at, goals = [], []
    for k, target in enumerate(targets):
        names = sorted({c[k] for c in cells})
        place = {n: i for i, n in enumerate(names)}
        at.append(np.array([place[c[k]] for c in cells], np.int64))
        goal = np.array([target.get(n, 0.0) for n in names], float)
        goals.append(goal / (goal.sum() or 1.0))
    for _ in range(rounds):
        for where, goal in zip(at, goals, strict=True):
            total = np.bincount(where, w, len(goal))
            w = w * np.where(total > 0, goal / np.where(total > 0, total, 1), 0)[where]
        w = np.minimum(w, trim * observed)
    whole = w.sum() or 1.0
    return w, max(float(np.abs(np.bincount(where, w, len(goal)) / whole - goal).max()) for where, goal in zip(at, goals, strict=True))


def tempered(cells: list[tuple], weights: list[float], k: int, power: float) -> dict:
    total: dict = {}
    for c, w in zip(cells, weights, strict=True):
        total[c[k]] = total.get(c[k], 0.0) + w
    whole = sum(v**power for v in total.values())
    return {n: v**power / whole for n, v in total.items()}


def probabilities(docs: DataFrame, targets: dict[str, dict] | None = None) -> DataFrame:
    """All columns of docs as struct row, then n_tokens, probability, kept; docs has doc_id, text, lang and source."""
    spark = docs.sparkSession
    names = anchors(docs)
    cell = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")]
    rows = measured(docs.select(*cell, "text"), names)
    found = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).orderBy("source", "lang", "topic").limit(MAX_CELLS + 1).collect()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} combinations of source, language and topic")
    cells, observed = [(r.source, r.lang, r.topic) for r in found], [float(r.n) for r in found]
    goals = [(targets or {}).get(name) or tempered(cells, observed, k, POWERS[name]) for k, name in enumerate(("source", "lang", "topic"))]
    factors = np.zeros(0)
    if cells:
        fitted, miss = rake(cells, observed, goals)
        if miss > TOLERANCE:
            warnings.warn(f"a target share is missed by {miss:.4f}", stacklevel=2)
        factors = fitted / np.array(observed)
    top = factors.max() if len(factors) and factors.max() > 0 else 1.0
    table = spark.createDataFrame([(*c, float(f)) for c, f in zip(cells, factors / top, strict=True)], "source string, lang string, topic string, probability double")
    joined = measured(carried(docs).withColumns({"doc_id": F.col("row.doc_id"), "source": F.coalesce("row.source", F.lit("")), "lang": F.coalesce("row.lang", F.lit(""))}), names).join(F.broadcast(table), ["source", "lang", "topic"], "left")
    return joined.select("row", "n_tokens", "probability", (unit(F.col("doc_id")) < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None) -> DataFrame:
    """The sampled rows of docs."""
    return probabilities(docs, targets).where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = probabilities(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("row.doc_id", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def SQL() -> str:  # noqa: N802
    shares = ", ".join(f"t_{d} AS (SELECT {d}, s / sum(s) OVER () AS goal FROM (SELECT {d}, power(sum(n), {POWERS[d]}) AS s FROM c GROUP BY {d}))" for d in ("source", "lang", "topic"))
    steps, last = [], "c"
    for i in range(ROUNDS):
        for d in ("source", "lang", "topic"):
            scaled = f"w * goal / sum(w) OVER (PARTITION BY x.{d})"
            w = f"least({scaled}, {TRIM} * n / sum(n) OVER ())" if d == "topic" else scaled
            steps.append(f"w_{i}_{d} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, n, {w} AS w FROM {last} x JOIN t_{d} USING ({d}))")
            last = f"w_{i}_{d}"
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS unit,
 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT row_number() OVER () AS k, ws FROM d WHERE unit * (SELECT count(*) FROM documents) < {SAMPLE}),
a AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (SELECT DISTINCT k, unnest(ws) AS word FROM s) WHERE length(word) >= {LETTERS} GROUP BY word)
 WHERE n * {COMMON} <= (SELECT count(*) FROM s) ORDER BY n DESC, word LIMIT {TOPICS}),
h AS (SELECT doc_id, word, rank, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM d) JOIN a USING (word) GROUP BY ALL),
b AS (SELECT doc_id, word FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rank) = 1),
r AS MATERIALIZED (SELECT doc_id, source, lang, unit, CAST(greatest(len(ws), 1) AS BIGINT) AS n_tokens, CASE WHEN len(ws) = 0 THEN 'empty' ELSE coalesce(word, 'other') END AS topic FROM d LEFT JOIN b USING (doc_id)),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(sum(n_tokens) AS DOUBLE) / sum(sum(n_tokens)) OVER () AS w FROM r GROUP BY ALL),
{shares}, {", ".join(steps)},
p AS (SELECT source, lang, topic, (w / n) / max(w / n) OVER () AS probability FROM {last})
SELECT doc_id, n_tokens, round(probability, 6) AS probability, unit < probability AS kept FROM r JOIN p USING (source, lang, topic)
"""
