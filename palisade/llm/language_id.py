"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is the average of the subword embeddings of its words, put through a linear softmax over the languages seen in
training. Texts kept out of training fit a temperature, and give the threshold of rejection: the confidence that all but
REJECT of those that were told right reach, at most CEILING.

Size: training takes at most PER_CLASS documents of each language and MOST of all languages together, one of each at least
(documented bounds; documents are picked by a hash of doc_id); all texts are read whole, in training, calibration and scoring.
The driver holds one text's words at a time, and of each training text a bag of at most BUCKETS counted buckets (6 bytes each). The model is
one embedding for each bucket and one column for each language. Scoring is one pass over all rows without a shuffle.

Defined cases: a null text, or one without a letter, is "und" with score 0 and rejected; if nothing could be learned, all
texts are "und" with score 0, but those with letters are not rejected, as nothing speaks against them; a text with letters
otherwise always gets a learned language. Rows are returned one for one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import carried, extended, fold, load, passed, training_sample
from palisade.llm.subword import BUCKETS, CHUNK_WORDS, GRAMS, WIDTH, Bags, grams, softmax, summed, words_of

PER_CLASS, MOST, FOLDS, HELD_OUT = 500, 10_000, 4, 2
ROUNDS, BATCH, RATE = 6, 32, 8.0
#: Share of rightly told texts that the threshold may reject, and its highest value.
REJECT, CEILING = 0.001, 0.5


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); superscripts and circled numbers are none."""
    return any(map(str.isalpha, text))


class Model:
    """table: the embeddings; soft and bias: the softmax."""

    def __init__(self, languages: list[str], table: np.ndarray, soft: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        self.languages, self.table, self.soft, self.bias = languages, table.astype(np.float32), soft, bias
        self.temperature, self.threshold = temperature, threshold


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of a text, and how often each comes."""
    words, total = words_of(text), np.zeros(BUCKETS)
    for i in range(0, len(words), CHUNK_WORDS):
        total += np.bincount(grams(words[i : i + CHUNK_WORDS], GRAMS, BUCKETS)[0], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.uint16), total[found].astype(np.float32)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    rows = [(t, y) for t, y in rows if t and y is not None and has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    cut = len(rows) // 5
    number = {y: i for i, y in enumerate(languages)}
    label = np.array([number[y] for _, y in rows])
    bags = [bag(t) for t, _ in rows[cut:]]
    kept = [t for t, _ in rows[:cut]]
    del rows
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    soft, bias = rng.normal(0, 0.5, (WIDTH, len(languages))), np.zeros(len(languages))
    steps = [np.arange(i, min(i + BATCH, len(bags))) for i in range(0, len(bags), BATCH)]
    for round_ in range(ROUNDS):
        rate = RATE * (1 - round_ / ROUNDS)
        for i in rng.permutation(len(steps)).tolist():
            at = steps[i]
            rows_, times = zip(*(bags[j] for j in at.tolist()), strict=True)
            now = Bags(np.concatenate(rows_), np.repeat(np.arange(len(at)), list(map(len, rows_))), np.concatenate(times))
            mean = now.mean(table)
            g = softmax(mean @ soft + bias)
            g[np.arange(len(at)), label[cut + at]] -= 1
            g /= len(at)
            back = g @ soft.T / now.counts[:, None]
            touched, where = np.unique(now.rows, return_inverse=True)
            each = back[now.of] * now.times[:, None]
            table[touched] -= rate * 20 * np.stack([np.bincount(where, each[:, k]) for k in range(WIDTH)], 1)
            soft -= rate * 0.1 * (mean.T @ g)
            bias -= rate * 0.02 * g.sum(0)
    model = Model(languages, table, soft, bias)
    if cut:
        teller = Teller(model)
        z = np.stack([teller.logits(t) for t in kept])
        losses = [(-np.log(softmax(z / t)[np.arange(cut), label[:cut]] + 1e-12).mean() + 0.002 * t, t) for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)]
        model.temperature = min(losses)[1]
        p = softmax(z / model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == label[:cut]])
        model.threshold = float(min(CEILING, right[int(REJECT * len(right))])) if len(right) else 0.0
    return model


class Teller:
    """Applies a model."""

    def __init__(self, model: Model | None) -> None:
        self.model = model

    def logits(self, text: str) -> np.ndarray:
        """The scores of the languages for a whole text, before the temperature."""
        total, n = summed(self.model.table, words_of(text), GRAMS)
        return (total / (n or 1)) @ self.model.soft + self.model.bias

    def tell(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not has_letter(text):
            return "und", 0.0, True
        if self.model is None:
            return "und", 0.0, False
        z = self.logits(text) / self.model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(p[best] < self.model.threshold)


def _tell(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teller = Teller(model)
        for batch in batches:
            told = [teller.tell(t) for t in batch.column("text").to_pylist()]
            columns, names = passed(batch, ("text",))
            columns += [pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()), pa.array([x[2] for x in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "rejected"])

    return run


def fit(docs: DataFrame, per_class: int = PER_CLASS, most: int = MOST) -> Model | None:
    """A model from rows of docs(doc_id, text, lang), without the held-out fold: per_class of each language at most, most in all."""
    rows = docs.select("doc_id", "lang").where(fold("doc_id", FOLDS) != HELD_OUT)
    return train(training_sample(rows, docs, "lang", per_class, 4, most)[0])


def tell(rows: DataFrame, model: Model | None) -> DataFrame:
    """The columns of rows but text, then lang_pred, score, rejected."""
    return rows.mapInArrow(_tell(model), extended(rows, ("text",), "lang_pred string, score double, rejected boolean"))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text)."""
    return tell(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text"), model)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs(text, and any other columns) whose language is told with confidence."""
    return tell(carried(docs), model).where("NOT rejected").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


SQL = None
