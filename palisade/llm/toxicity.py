"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the average of the embeddings of the subwords (character n-grams, and the word itself) of its distinct words, put
through a two-class linear softmax; embeddings and softmax are trained together from document labels alone. A misspelt word
shares most n-gram vectors with the word that it comes from, and runs of any length are read whole. A logistic curve fitted on labelled documents that were kept out of training turns log-odds into a score.

Size: training takes at most PER_CLASS labelled rows of each label (a documented bound; rows are picked by a hash of
doc_id), whole; scoring is one pass over all rows without a shuffle, and nothing is kept from one text to the next.

Defined cases: a null text, or one without words, gets the score of an average of nothing, that is of the softmax's bias alone,
but never over 0.49; without labelled rows of both kinds every score is 0. A doc_id labelled twice counts once, one labelled both
ways counts for both labels. Rows are returned one for one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fold, load, training_sample
from palisade.llm.subword import Adam, Bags, grams, summed, words_of

#: Labelled rows of each label at most; held-out fold.
PER_CLASS, FOLDS, HELD_OUT = 2500, 5, 0
LENGTHS, BUCKETS, WIDTH = (3, 4, 5), 1 << 17, 4
ROUNDS, RATE, DECAY = 150, 0.08, 2e-6
#: One of so many labelled rows is kept out to fit the logistic curve.
KEPT_OUT = 8
#: What toxic texts weigh together when the curve is fitted; the others weigh the rest.
TOXIC = 0.4


class Model:
    """table: the log-odds of each bucket, of which a text's are the mean; the softmax's bias; the logistic curve's slope and shift."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, slope, shift

    def score(self, odds: float | None) -> float:
        """The score for log-odds; None: of a text without words."""
        p = float(1 / (1 + np.exp(-np.clip(self.slope * (self.bias if odds is None else odds) + self.shift, -30, 30))))
        return min(p, 0.49) if odds is None else p


def train(rows: list[tuple[str, int]], seed: int = 7) -> Model | None:
    docs = [(sorted(set(words_of(t))), int(y)) for t, y in rows if y in (0, 1)]
    docs = [(w, y) for w, y in docs if w]
    if len({y for _, y in docs}) < 2:
        return None
    rng = np.random.default_rng(seed)
    docs = [docs[i] for i in rng.permutation(len(docs))]
    cut = len(docs) // KEPT_OUT
    if any(len({y for _, y in part}) < 2 for part in (docs[:cut], docs[cut:])):
        cut = 0
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for ws, _ in docs[cut:] for w in ws], np.int32)
    of = np.repeat(np.arange(len(docs) - cut), [len(ws) for ws, _ in docs[cut:]])
    rows_, owners = grams(list(known), LENGTHS, BUCKETS, owned=True)
    order = np.argsort(owners, kind="stable")
    words = Bags(rows_[order], owners[order])
    del rows_, owners, order
    y = np.array([y for _, y in docs[cut:]], float)
    size = np.bincount(of, words.counts[flat])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    table = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    soft = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.array([-1.0])
    adam = Adam(RATE)
    for _ in range(ROUNDS):
        # As all is linear, averages of embeddings times the softmax are averages of the buckets' log-odds.
        direction = soft[:, 1] - soft[:, 0]
        odds = np.bincount(of, words.sums(table @ direction)[flat]) / size + bias[0]
        g = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
        g_word = np.bincount(flat, (g / size)[of], len(known))
        g_bucket = np.bincount(words.rows, g_word[words.of], BUCKETS)
        g_dir = table.T @ g_bucket
        adam.step(table=(table, g_bucket[:, None] * direction + DECAY * table), soft=(soft, np.stack([-g_dir, g_dir], 1)), bias=(bias, np.array([g.sum()])))
    model = Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[0]))
    if cut:
        model.slope, model.shift = _logistic(np.array([document(model, ws) for ws, _ in docs[:cut]]), np.array([y for _, y in docs[:cut]], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0.05 to 3) and shift of a logistic curve, by gradient descent on the log loss with a pull towards slope 1 and shift 0, as few texts are kept out."""
    x = np.clip(x, -15, 15)
    weight = np.where(y > 0, TOXIC / y.sum(), (1 - TOXIC) / (len(y) - y.sum()))
    w, adam = np.array([1.0, 0.0]), Adam(0.05)
    for _ in range(400):
        g = weight * (1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30))) - y)
        adam.step(w=(w, np.array([(g * x).sum(), g.sum()]) + 5e-2 * (w - [1.0, 0.0])))
        w[0] = min(max(w[0], 0.05), 3.0)
    return float(w[0]), float(w[1])


def document(model: Model, words: list[str]) -> float | None:
    """The log-odds of a text with these distinct words; None without words."""
    total, n = summed(model.table, words, LENGTHS)
    return float(total) / n + model.bias if n else None


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(document(model, sorted(set(words_of(t or ""))))) if model else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels has doc_id and toxic."""
    rows = labels.select("doc_id", "toxic").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
    model = train(training_sample(rows.where("toxic IN (0, 1)"), docs, "toxic", per_class, 3)[0])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    return out.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = None
