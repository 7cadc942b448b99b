"""Queries with SQL against it; the others against brute force or held-out labels."""

from __future__ import annotations

import re
import zlib

import duckdb
import pandas as pd
import pytest

from palisade.llm import html_extract
from palisade.llm.registry import MODULES, oracle_sql, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SF).toPandas()[list(want.columns)]
    for df in (got, want):
        df.sort_values("doc_id", inplace=True, ignore_index=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def _held_out(spark, name, label, fold, remainder):
    got = queries()[name](spark, LARGER).toPandas()
    labels = pd.read_parquet(f"{LARGER}/labels.parquet").drop_duplicates("doc_id")
    both = got.merge(labels, on="doc_id")
    both = both[[zlib.crc32(str(i).encode()) % fold == remainder for i in both.doc_id]]
    assert both.held_out.all() and got.score.between(0, 1).all()
    return (both.predicted == both[label]).mean(), both


def test_toxicity_on_held_out_labels(spark):
    accuracy, both = _held_out(spark, "op3_toxicity", "toxic", 5, 0)
    assert accuracy > 0.96
    caught = both[both.toxic == 1].predicted.mean()
    assert caught > 0.85 and both[both.toxic == 0].predicted.mean() < 0.04


def test_quality_on_held_out_labels(spark):
    accuracy, both = _held_out(spark, "op7_quality_classifier", "quality", 4, 2)
    assert accuracy > 0.96 and both[both.quality == 1].predicted.mean() > 0.96 and both[both.quality == 0].predicted.mean() < 0.1


def test_language_on_held_out_documents(spark):
    got = queries()["op5_language_id"](spark, LARGER).toPandas()
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    both = got.merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    both = both[both.held_out]
    assert (both.lang_pred == both.lang).mean() > 0.995
    assert both.rejected.mean() < 0.005


def _blocks(source):
    import html
    import re

    body = source.split("<article>", 1)[1].split("</article>")[0]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in blocks if x)


FORMS = {
    "marked": lambda h: h,
    "plain": lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>"),
    "numbered": lambda h: h.replace("<article>", "<section class=post id=p77>").replace("</article>", "</section>"),
    "only div": lambda h: re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", h),
}


@pytest.mark.parametrize("form", FORMS)
def test_pages_against_a_plain_reading(spark, form):
    """With article marks, without, and without any element that names its role."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    rows = spark.createDataFrame([(int(i), u, FORMS[form](h)) for i, u, h in zip(pages.page_id, pages.url, pages.html, strict=True)], "page_id long, url string, html string")
    if form == "marked":
        got = queries()["op4_html_extract"](spark, "/root/testdata/sf0.01").toPandas()
    else:
        got = html_extract.extract_pages(rows).toPandas()
    want = {int(i): _blocks(h) for i, h in zip(pages.page_id, pages.html, strict=True)}
    assert dict(zip(got.page_id, got.text, strict=True)) == want
    assert list(got.n_chars) == [len(t) for t in got.text]


@pytest.mark.parametrize("form", ["marked", "plain"])
def test_the_template_decides(monkeypatch, form):
    pages = [FORMS[form](h) for h in pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html.head(8)]
    right = html_extract.extract(pages)
    monkeypatch.setattr(html_extract, "template", lambda found: ({}, set(), set()))
    assert html_extract.extract(pages) != right


def test_names():
    assert [n.split("_")[0] for n in MODULES] == [f"op{i}" for i in range(1, 11)]
