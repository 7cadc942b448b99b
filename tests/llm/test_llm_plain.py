"""Models against plain scorers: dictionaries of floats and fresh compressors in place of arrays, caches and batches."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from palisade.llm import language_id, quality_classifier, subword, toxicity
from palisade.llm.common import fold, training_sample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


_LAST = (1 << 64) - 1
_FACTOR, _TAG = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _grams(word, lengths, buckets):
    """The buckets of "<word>" and of its n-grams, one at a time."""
    w = f"<{word}>"
    out = []
    for piece, k in [(w, 0)] * (len(w) <= 42) + [(w[i : i + k], k) for k in lengths for i in range(len(w) - k + 1)]:
        h = 0
        for c in piece:
            h = (h * _FACTOR + ord(c) + 1) & _LAST
        h ^= k * _TAG & _LAST
        h = (h ^ (h >> 32)) * _TAG & _LAST
        h = (h ^ (h >> 29)) * _FACTOR & _LAST
        out.append(h >> (65 - buckets.bit_length()))
    return out


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def test_buckets_equal_plain_ones(monkeypatch):
    words = ["a", "stupid", "é", "中" * 90, "x" * 40, "y" * 41, "😀b", "z1"] * 3
    for lengths, buckets in (((2, 3, 4), 1 << 16), ((3, 4, 5), 1 << 17)):
        rows, owners = subword.grams(words, lengths, buckets, owned=True)
        for i, w in enumerate(words):
            assert sorted(rows[owners == i].tolist()) == sorted(_grams(w, lengths, buckets))
    table = np.random.default_rng(1).random((1 << 16, 3)).astype(np.float32)
    whole = subword.summed(table, words)
    monkeypatch.setattr(subword, "CHUNK_WORDS", 5)
    monkeypatch.setattr(subword, "CHUNK_ROWS", 7)
    parts = subword.summed(table, words)
    assert parts[1] == whole[1] == sum(len(_grams(w, (2, 3, 4), 1 << 16)) for w in words) and np.allclose(parts[0], whole[0], rtol=1e-5)


def test_toxicity_equals_a_plain_scorer(spark):
    docs, labels = _docs(spark), _labels(spark)
    rows = labels.select("doc_id", "toxic").where((fold("doc_id", 5) != 0) & F.col("toxic").isin(0, 1))
    model = toxicity.train(training_sample(rows, docs, "toxic", toxicity.PER_CLASS, 3)[0])
    odds = dict(enumerate(model.table.tolist()))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        bag = [g for w in set(_words(texts[r.doc_id])) for g in _grams(w, (3, 4, 5), toxicity.BUCKETS)]
        z = sum(odds[g] for g in bag) / len(bag) + model.bias if bag else model.bias
        want = _sigmoid(model.slope * z + model.shift)
        assert r.score == pytest.approx(want if bag else min(want, 0.49), abs=1e-4)
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_equals_a_plain_scorer(spark):
    docs = _docs(spark)
    model = language_id.fit(docs)
    table, soft = model.table.tolist(), model.soft.tolist()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in language_id.identify(docs, model).collect():
        text = texts[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        bag = [g for w in _words(text) for g in _grams(w, (2, 3, 4), language_id.BUCKETS)]
        mean = [sum(table[g][k] for g in bag) / len(bag) for k in range(len(soft))]
        z = [(sum(m * soft[k][j] for k, m in enumerate(mean)) + model.bias[j]) / model.temperature for j in range(len(model.languages))]
        e = [math.exp(x - max(z)) for x in z]
        best = max(range(len(e)), key=e.__getitem__)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(e[best] / sum(e), abs=1e-4)


def test_quality_equals_a_plain_scorer(spark):
    docs, labels = _docs(spark), _labels(spark)
    rows = labels.select("doc_id", "quality").where((fold("doc_id", 4) != 2) & F.col("quality").isin(0, 1))
    sample, counts = training_sample(rows, docs, "quality", quality_classifier.PER_CLASS, 6)
    model = quality_classifier.train(sample, counts[1] / (counts[0] + counts[1]))

    def size(content, text):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=quality_classifier.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False).compress(text))

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    slope, shift = model.weights
    for r in quality_classifier.score_quality(docs, labels).collect():
        text = (texts[r.doc_id] or "").encode()
        difference = 10 * (size(model.bad, text) - size(model.good, text)) / (len(text) + 20)
        assert r.score == pytest.approx(_sigmoid(slope * difference + shift), abs=1e-6)
        assert r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_samples(spark):
    """At most so many rows of each value, most in all, the same ones on every run and however rows are dealt."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 40 == 0, "rare").when(F.col("id") == 7, "one").otherwise("common").alias("lang"))
    docs = rows.select("doc_id", F.concat(F.lit("t"), "doc_id").alias("text"))
    again = docs.unionByName(docs.where("doc_id < 100")).repartition(7)
    for most, want in ((None, {"rare": 50, "common": 50, "one": 1}), (30, {"rare": 10, "common": 10, "one": 1})):
        picked, counts = training_sample(rows, docs, "lang", 50, 4, most)
        assert counts == {"rare": 100, "common": 3899, "one": 1}
        assert {y: sum(1 for _, z in picked if z == y) for y in counts} == want
        assert training_sample(rows.repartition(5), again, "lang", 50, 4, most)[0] == picked
    assert training_sample(rows.limit(0), docs, "lang", 5, 1) == ([], {})
    both = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert sorted(training_sample(both, spark.createDataFrame([(1, "x"), (1, "a"), (2, "b")], "doc_id long, text string"), "toxic", 5, 1)[0]) == [("a", 0), ("a", 1)]


def test_defined_scores(spark):
    rows = [(i, "good words all around here" if i % 2 else "b@d | b@d | b@d", "xy"[i % 2]) for i in range(40)] + [(100, None, None), (101, "", None), (102, "²", "x"), (None, "good words", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert told[100] == told[101] == told[102] == ("und", 0.0) and told[1][0] == "y" and None in told
    nothing = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and language_id.accepted(docs, nothing).count() == 41 and language_id.accepted(docs, language_id.fit(docs)).where("doc_id IN (100, 101, 102)").count() == 0
    toxic = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert toxic[100].score == toxic[101].score < 0.5 and toxic[100].predicted == 0 and not toxic[None].held_out
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("toxic = 1")).collect()} == {0.0}
    quality = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, labels).collect()}
    assert quality[100] == quality[101] and quality[1] > quality[0]
    assert {r.score for r in quality_classifier.score_quality(docs, labels.limit(0)).collect()} == {0.0}
