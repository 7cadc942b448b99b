"""Quality classifier: texts are compressed with zstandard dictionaries built from good and from bad labelled texts.

Each label's dictionary is raw content: DICTIONARY_ROWS labelled texts at most, whole, drawn at random. A text that a
dictionary's label resembles compresses better with it. The difference of the two compressed sizes, normalised by the length
of the text, is all that counts; a logistic curve over it, fitted on labelled texts that are in no dictionary, turns it into a
score calibrated to the share of good texts among all labelled ones.

Size: at most PER_CLASS labelled rows of each label are fetched, of which DICTIONARY_ROWS at most, and a third at most, make the
dictionary (documented bounds; rows are picked by a hash of doc_id); scoring is one pass over all rows without a shuffle, over
whole texts.

Defined cases: null and empty texts are scored as the empty text; without labelled rows of both kinds every score is 0. A doc_id
labelled twice counts once, one labelled both ways counts for both labels. Rows are returned one for one; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import fold, load, texts, training_sample

PER_CLASS, DICTIONARY_ROWS, FOLDS, HELD_OUT, CUTOFF = 1500, 400, 4, 2, 0.7
LEVEL = 9
#: The difference of the sizes is taken for each byte of a text and so many more, as a frame without text has some.
FRAME, SCALE = 20, 10


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray) -> None:
        self.good, self.bad, self.weights = good, bad, weights


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.pack = []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.pack.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False).compress)

    def difference(self, text: bytes) -> float:
        good, bad = (len(pack(text)) for pack in self.pack)
        return SCALE * (bad - good) / (len(text) + FRAME)

    def score(self, text: bytes | None) -> float:
        slope, shift = self.model.weights
        return float(1 / (1 + np.exp(-np.clip(slope * self.difference(text or b"") + shift, -30, 30))))


def train(rows: list[tuple[str, int]], share: float = 0.5, seed: int = 9) -> Model | None:
    """share: that of good texts among all labelled ones; the score is calibrated to it."""
    by = {y: [t.encode("utf-8", "surrogatepass") for t, label in rows if label == y and t] for y in (0, 1)}
    if not by[0] or not by[1]:
        return None
    rng = np.random.default_rng(seed)
    content, rest = {}, {}
    for y, found in by.items():
        order = rng.permutation(len(found)).tolist()
        cut = min(DICTIONARY_ROWS, max(1, len(found) // 3))
        content[y] = b"\n".join(found[i] for i in order[:cut])
        rest[y] = [found[i] for i in order[cut:]]
    model = Model(content[1], content[0], np.zeros(2))
    scorer = Scorer(model)
    x = np.array([[scorer.difference(t), 1.0] for y in (0, 1) for t in rest[y]]).reshape(-1, 2)
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 1e-3 * w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    model.weights = w
    return model


_FIELDS = "doc_id long, held_out boolean, score double, predicted int"


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            scores = [scorer.score(t) if scorer else 0.0 for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= CUTOFF) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels has doc_id and quality."""
    rows = labels.select("doc_id", "quality").where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("quality").isNotNull())
    sample, counts = training_sample(rows.where("quality IN (0, 1)"), docs, "quality", per_class, 6)
    model = train(sample, min(max(counts.get(1, 0) / max(1, sum(counts.values())), 0.05), 0.95))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    return out.mapInArrow(_score(model), _FIELDS)


def query(spark, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = None
