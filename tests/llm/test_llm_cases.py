"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names; and brute force on small cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import components, decontaminate, html_extract, language_id, minhash_dedup, mixing, quality_classifier, quality_rules, sharding, substring_dedup, subword, toxicity
from palisade.llm.components import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 4000}x{i}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c", "x " * 40, " é ß z", LONG, "😀 " * 30]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Odd texts, null ids, a repeated row, and columns whose names clash with those that operators add."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "a b c", None, None, 1)]
    df = docs(spark, rows)
    return df.withColumns({c: F.lit("x") for c in ("row", "spans", "items", "score", "kept", "n_words", "bucket", "words", "topic", "slot", "h", "rejected", "contaminated", "probability", "component_id", "host")})


def labels(spark, rows=()):
    return docs(spark, list(rows), "doc_id long, quality int, toxic int")


CALLS = {
    "substring": lambda s, d: substring_dedup.dedup_substrings(d),
    "rules": lambda s, d: quality_rules.judge(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s, [(3, 1, 0), (4, None, None), (7, 0, 1), (9, 1, 1), (None, 1, 1)])),
    "language": lambda s, d: language_id.identify(d, language_id.fit(d)),
    "benchmark": lambda s, d: decontaminate.find_benchmark(d, docs(s, [(1, "A b C"), (2, None), (None, "x x")], "item_id long, text string")),
    "quality": lambda s, d: quality_classifier.score_quality(d, labels(s, [(3, 1, 0), (4, 0, None), (7, 0, 1), (8, 1, 0), (6, 0, 0)])),
    "mixing": lambda s, d: mixing.probabilities(d).drop("row"),
    "sharding": lambda s, d: sharding.placed(d),
}


@pytest.mark.parametrize("name", CALLS)
def test_odd_and_empty_tables(spark, name):
    df = odd(spark)
    assert CALLS[name](spark, df).count() == df.count()
    assert CALLS[name](spark, df.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(odd(spark)).collect()}
    assert [got[i].n_shingles for i in range(7)] == [0, 0, 0, 1, 1, 1, 1]
    assert got[5].component_id == 4 and not got[5].kept and got[4].kept
    assert got[0].component_id == 0 and got[1].component_id == 1
    assert minhash_dedup.near_duplicates(odd(spark).limit(0)).count() == 0
    kept = minhash_dedup.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id IS NULL").count() == 1


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "y"), (2, "http://a/1", "", "x", "y"), (3, "http://a/2", "<p>a<p>b &amp; c", "x", "y"), (3, "http://a/2", "<p>a<p>b &amp; c", "x", "y"), (None, "http://a/3", "<aside>no</aside>plain", "x", "y"), (5, "::", "<script>x</script><article><h1>T</h1>a\n b<br>c<form>f</form></article><footer>z", "x", "y")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(docs(spark, rows, schema)).collect()}
    assert got == {1: "", 2: "", 3: "a\n\nb & c", None: "plain", 5: "T\n\na b c"}
    assert html_extract.extract_pages(docs(spark, rows, schema).limit(0)).count() == 0


def test_template_text_is_left_out():
    pages = [f"<body><div>Top of site</div><div><p>Story {i} begins here and goes on for long</p><p>More of {i}</p></div><div>About us</div>" for i in range(8)]
    assert html_extract.extract(pages) == [f"Story {i} begins here and goes on for long\n\nMore of {i}" for i in range(8)]


def test_short_slots_stay():
    long = "A paragraph that goes on. " * 40
    page = f"<body><h1>Title</h1><p>{long}</p><h2>Part</h2><p>{long}</p><blockquote>Quote</blockquote><p>{long}</p><p>End</p><footer>no</footer>"
    assert html_extract.extract([page])[0].split("\n\n") == ["Title", long.strip(), "Part", long.strip(), "Quote", long.strip(), "End"]


def test_repeated_text_stays_unless_it_is_template():
    same = "<p>One passage that all share</p><p>And a second one</p>"
    kept = "One passage that all share\n\nAnd a second one\n\nOwn {}"
    for n in (3, 4, 64):  # in a marked article
        assert html_extract.extract([f"<body><article>{same}<p>Own {i}</p></article>" for i in range(n)]) == [kept.format(i) for i in range(n)]
    # revisions of one url among other pages, without a marked article
    pages = [f"<body><div>{same}<p>Own {i}</p></div>" for i in range(40)] + [f"<body><div><p>Other {i}</p></div>" for i in range(24)]
    urls = ["http://a/1"] * 40 + [f"http://a/x{i}" for i in range(24)]
    assert html_extract.extract(pages, urls) == [kept.format(i) for i in range(40)] + [f"Other {i}" for i in range(24)]
    # a passage that more than half of the articles share, with no tags of its own
    pages = [f"<body><div>Site</div><div>{same if i < 30 else ''}<p>Own {i}</p></div>" for i in range(40)]
    assert html_extract.extract(pages) == [kept.format(i) if i < 30 else f"Own {i}" for i in range(40)]


def test_groups_do_not_depend_on_partitions(spark):
    n = 129
    rows = [(i, f"http://a/{i}", f"<body><div>Top of site</div><div><p>Own {i}</p></div><div>About us</div>") for i in range(n)]
    pages = docs(spark, rows, "page_id long, url string, html string")
    sizes = [r.n for r in html_extract.grouped(pages).groupBy("host", "group").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) == 3 and min(sizes) > 20
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()} == {i: f"Own {i}" for i in range(n)}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_long_runs_are_read_whole():
    run = "".join(f"{chr(0x4E00 + i)}" for i in range(5000))
    n = len(f"<{run}>")
    for lengths in ((2, 3, 4), (3, 4, 5)):
        assert len(subword.grams(subword.words_of(f"{run},"), lengths)[0]) == sum(n - k + 1 for k in lengths)
    told = language_id.train([(f"{a * 10}", y) for a, y in (("abcd ", "x"), ("efgh ", "y")) for _ in range(40)])
    ends = "abcd" * 6
    assert language_id.Teller(told).tell(ends + "efgh" * 200 + ends)[0] == "y"
    model = toxicity.train([("fine words here", 0), ("fine stupidfool here", 1)] * 40)
    mild = "finewordshere" * 40
    assert toxicity.document(model, subword.words_of(mild + "stupidfool" + mild)) > toxicity.document(model, subword.words_of(mild + mild)) + 0.1


def test_letters():
    model = language_id.train([(f"{a} " * 30, y) for a, y in (("abcd", "x"), ("efgh", "y")) for _ in range(10)])
    for t in (None, "", " \n", "²½①", "123 -- 4", "\u0301"):
        assert language_id.Teller(model).tell(t) == ("und", 0.0, True) and language_id.Teller(None).tell(t) == ("und", 0.0, True)
    for t in ("a", "1é2", "中", "ª"):
        assert language_id.Teller(model).tell(t)[0] in "xy" and language_id.Teller(None).tell(t) == ("und", 0.0, False)


def test_kept_out_texts_are_told_whole(monkeypatch):
    read = []
    words_of = language_id.words_of
    monkeypatch.setattr(language_id.Teller, "logits", lambda self, text, f=language_id.Teller.logits: read.append(len(words_of(text))) or f(self, text))
    assert language_id.train([(f"{a} " * 1000, y) for a, y in (("abcd", "x"), ("efgh", "y")) for _ in range(20)])
    assert read == [1000] * 8


def _brute_substrings(rows, k):
    first = {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, (i, s)), (i, s))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        drop = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (i, s):
                drop.update(range(s, s + k))
        out[i] = (len(w), len(drop), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in drop)).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(10, 80))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 % 120, "\n".join(parts)))
    want = _brute_substrings(rows, 20)
    df = docs(spark, rows, "doc_id long, text string").repartition(5)
    for load, chunk in ((substring_dedup.LOAD_BYTES, substring_dedup.CHUNK_WORDS), (200, 300)):  # the second one takes several passes over each bucket
        monkeypatch.setattr(substring_dedup, "LOAD_BYTES", load)
        monkeypatch.setattr(substring_dedup, "BUCKET_MOST", 4 * load)
        monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
        got = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want


def test_repeats_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        words = [[rng.choice("abc").encode() for _ in range(rng.randint(0, 60))] for _ in range(4)]
        repeat, covered, longest = quality_rules._chunk(words)
        for w, r, c, most in zip(words, repeat, covered, longest, strict=True):
            for k, got in ((5, r), (8, c)):
                seen = {}
                for i in range(len(w) - k + 1):
                    seen.setdefault(tuple(w[i : i + k]), []).append(i)
                assert got == len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + k)})
            best = max((k for k in range(1, len(w)) if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1), default=0)
            assert most == best


def test_benchmark_in_blocks_equals_one(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 9, 10, 25])))) for i in range(20)]
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 80)))) for i in range(40)]
    b, d = docs(spark, items, "item_id long, text string"), docs(spark, texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.find_benchmark(d, b).collect()}
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.find_benchmark(d, b, block_bytes=100).collect()} == got
    for i, t in texts:
        w, hit, found = t.split(), set(), set()
        for item, s in items:
            x = s.split()
            for g in [x[j : j + 10] for j in range(max(1, len(x) - 9))] if x else []:
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add(item)
        assert got[i] == (len(hit), len(found))


def test_groups_of_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(60)] = f"n{rng.random()}"
            rows.append((rng.randrange(10**6), " ".join(w)))
    rows = list(dict(rows).items())
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs(spark, rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in parent}


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs with 4 of 5, 8 of 10 and 40 of 50 shingles, in bulk, against the sets themselves."""
    rows = []
    for k, n in enumerate((5, 10, 50)):
        for p in range(1500):
            words = [f"w{k}x{p}x{i}" for i in range(n + 3)]
            rows += [(2 * (1500 * k + p), " ".join(words)), (2 * (1500 * k + p) + 1, " ".join(words[: 3 + n * 4 // 5]))]
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        x, y = (set(minhash_dedup.shingles(t.encode()).tolist()) for _, t in (a, b))
        assert 100 * len(x & y) == 80 * len(x | y)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs(spark, rows, "doc_id long, text string")).collect()}
    assert [i for i, _ in rows if got[i] != i - i % 2] == []


def test_long_chains_are_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 901)], "a long, b long"))
    assert {(r.component, r.n) for r in connected(links).groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 301), (900, 2)}


def test_few_edges_take_few_jobs_and_equal_the_rounds(spark, monkeypatch):
    """A chain and a random graph, whose rounds took 107 jobs; with rounds for any number of edges, and for all but the last ones."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(250)]
    links = docs(spark, pairs, "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    few = {r.id: r.component for r in connected(links).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 15
    for most in (-1, 400):
        monkeypatch.setattr(components, "FEW", most)
        assert {r.id: r.component for r in connected(links).collect()} == few
    assert all(few[a] == few[b] <= a for a, b in pairs if a != b)
    monkeypatch.setattr(components, "FEW", 0)
    assert connected(links.limit(0)).count() == 0


def test_raking_meets_its_targets():
    cells = [(s, x, "t") for s in "ab" for x in "xyz"]
    w, miss = mixing.rake(cells, [5, 1, 3, 2, 2, 8], [{"a": 0.5, "b": 0.5}, {"x": 0.2, "y": 0.3, "z": 0.5}, {"t": 1.0}], 50, 100.0)
    assert miss < 1e-6
    assert np.isclose(sum(w[:3]), 0.5) and np.isclose(w[0] + w[3], 0.2) and np.isclose(w[1] + w[4], 0.3)


def test_lookup_table():
    full, less = sharding.lookup(), sharding.lookup(sharding.SHARDS[:-1])
    counts = np.bincount(full)
    assert len(full) == sharding.SLOTS and counts.max() - counts.min() <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True)) - counts[-1]
    assert moved < 0.1 * sharding.SLOTS
    for bad in (((), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_unseen_misspellings_share_grams():
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(6)) for _ in range(300)]
    rows = [(" ".join(rng.choices(words, k=30) + (["gwzkpfgqx"] if i % 2 else [])), i % 2) for i in range(400)]
    model = toxicity.train(rows)
    plain = " ".join(words[:30])
    assert model.score(toxicity.document(model, plain.split())) < 0.5
    assert model.score(toxicity.document(model, [*plain.split(), "gwzkpfgqx"])) > 0.5
    assert toxicity.document(model, ["gwzkpfgqy"]) > toxicity.document(model, [words[3]])


def test_pipeline_stages(spark):
    """Each stage on what the one before it kept, against plain versions."""
    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs_.columns
    rows = {r.doc_id: r for r in docs_.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs_
        docs_ = spark.createDataFrame(stage(spark, before, sf).toPandas())
        got = {r.doc_id for r in docs_.select("doc_id").collect()}
        assert got <= {r.doc_id for r in before.select("doc_id").collect()}
        assert docs_.columns == names + (["shard"] if k == 4 else []), name
        if name == "near_duplicates":
            assert got == {r.doc_id for r in minhash_dedup.near_duplicates(before).where("kept").collect()}
        if name == "benchmark":
            assert got == {r.doc_id for r in decontaminate.find_benchmark(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated").collect()}
    assert all(rows[r.doc_id].text == r.text for r in docs_.collect())
    assert len(got) > 0.3 * len(rows)


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark", "mixing", "sharding"]


def test_values_of_odd_rows(spark):
    """What operators say of null, empty, repeated and short texts, and of null ids."""
    rows = {r.doc_id: r for r in quality_rules.judge(docs(spark, [(1, None), (2, ""), (3, "a " * 40), (None, "# x\n# x\n")], "doc_id long, text string")).collect()}
    for i in (1, 2):
        assert tuple(rows[i])[1:] == (0, 0, 0, 0, 0, True, False, 0, 0)
    assert (rows[3].n_words, rows[3].n_repeat_words, rows[3].base_failed, rows[3].n_covered, rows[3].longest_repeat) == (40, 40, True, 40, 39)
    assert (rows[None].n_words, rows[None].n_symbols, rows[None].n_dup_lines, rows[None].base_failed) == (4, 2, 1, True)

    text = " ".join(f"w{i}" for i in range(30))
    same = [(7, text), (7, text), (9, text), (None, text), (None, None), (10, "short")]
    cut = substring_dedup.dedup_substrings(docs(spark, same, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in cut) == [(0, 0, 0), (0, 30, 0), (7, 30, 0), (7, 30, 0), (9, 30, 30), (10, 1, 0)]

    items = docs(spark, [("b", "x y"), ("b", "x y"), (None, "x y"), ("a", "X, y"), ("c", None)], "item_id string, text string")
    for size in (1 << 20, 3):
        hit = {r.doc_id: r for r in decontaminate.find_benchmark(docs(spark, [(1, "z x y"), (2, None), (None, "x y"), (3, "x z y")], "doc_id long, text string"), items, block_bytes=size).collect()}
        assert (hit[1].n_hit, hit[1].n_items, hit[1].items_sha256) == (2, 2, hashlib.sha256(b"a,b").hexdigest()) and hit[None].contaminated
        assert (hit[2].n_words, hit[2].n_hit, hit[2].items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest()) and not hit[3].contaminated

    placed = {(r.doc_id, r.shard) for r in sharding.placed(docs(spark, [(1,), (1,), (None,), (None,)], "doc_id long")).select("row.doc_id", "shard").collect()}
    assert len(placed) == 2


def test_topics_of_all_documents(spark, monkeypatch):
    """A word that only documents past a sample of 5,000 have; and counts that are sent on in parts."""
    outside = {i for i in range(6000) if int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / (1 << 52) * 6000 >= 5000}
    df = docs(spark, [(i, f"outside, Outside é{i}" if i in outside else "a") for i in range(6000)], "doc_id long, text string")
    assert mixing.anchors(df)[0] == "outside"
    monkeypatch.setattr(mixing, "HELD", 1)
    assert mixing.anchors(df)[0] == "outside"


def test_pipeline_mixes_by_topics_of_all_documents(spark):
    """A topic that no sample of 5,000 shows has its own share, so documents of the other one go."""
    outside = {i for i in range(6000) if int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / (1 << 52) * 6000 >= 5000 and i % 2}
    df = docs(spark, [(i, "outside" if i in outside else "a", "en", "s") for i in range(6000)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.stage_mixing(spark, df, "").select("doc_id").collect()}
    assert outside < kept and len(kept) < 6000


def test_unit_decides_nothing_but_what_is_kept(spark, monkeypatch):
    """With numbers under which a sample by unit would be empty, topics, tokens and probabilities stay; then nothing is kept."""
    df = docs(spark, [(i, "some words" if i % 7 else "other", "en", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string, source string")

    def judged():
        return sorted((r.row.doc_id, r.n_tokens, r.probability) for r in mixing.probabilities(df).collect())

    names, before = mixing.anchors(df), judged()
    monkeypatch.setattr(mixing, "unit", lambda doc_id: F.lit(1e6))
    assert mixing.anchors(df) == names == ["other"] and judged() == before
    assert mixing.mixed(df).count() == 0


def test_targets_of_mixing(spark):
    rows = [(i, "one two three", "en", "ab"[i % 2]) for i in range(400)]
    df = docs(spark, rows, "doc_id long, text string, lang string, source string")
    kept = mixing.mixed(df, {"source": {"a": 0.2, "gone": 0.5, "b": 0.8}, "lang": {"en": 1.0}, "topic": {"other": 1.0}})
    by = dict(kept.groupBy("source").count().collect())
    assert by["a"] < by["b"] and set(mixing.mixed(df, {"source": {"b": 1.0}, "lang": {"en": 1.0}, "topic": {"other": 1.0}}).select("source").distinct().toPandas().source) == {"b"}
    cells = [("a", "en", "other"), ("b", "en", "other")]
    w, miss = mixing.rake(cells, [1.0, 9.0], [{"a": 0.9, "b": 0.1}, {"en": 1.0}, {"other": 1.0}])
    assert w[0] == 2 * 0.1 and miss > mixing.TOLERANCE


def test_many_blocks_of_a_benchmark(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    items = [(str(i), " ".join(rng.choices(words, k=60))) for i in range(200)]
    texts = [(i, " ".join(rng.choices(words, k=40)) + " " + items[i % 200][1] + " tail") for i in range(60)] + [(99, "v1 v2")]
    b, d = docs(spark, items, "item_id string, text string"), docs(spark, texts, "doc_id long, text string")
    one = {tuple(r)[:6] for r in decontaminate.find_benchmark(d, b).drop("spans").collect()}
    assert {tuple(r)[:6] for r in decontaminate.find_benchmark(d, b, block_bytes=9_000).drop("spans").collect()} == one and len(one) == 61


def test_second_hubs_and_hot_keys(spark, monkeypatch):
    """A group whose smallest doc_id is an outlier, large enough to be hot."""
    from palisade.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(50), 5):
            w[4 * j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    got = {r.component_id for r in minhash_dedup.near_duplicates(docs(spark, rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_pages_that_are_broken(spark):
    same = "<p>One</p><p title=it's>Two it's</p><p class=\"x>Three</p><p>Four"
    assert html_extract.extract([same]) == ["One\n\nTwo it's\n\nThree\n\nFour"]
    deep = "<div>" * 3000 + "text" + "</div>" * 10
    assert html_extract.extract([deep]) == ["text"]
    long = "<body><nav><a href=x>menu</a></nav><div>" + "".join(f"<p>Paragraph {i} of many</p>" for i in range(5000)) + "</div><footer>f</footer>"
    assert html_extract.extract([long])[0].count("\n\n") == 4999
    math = "<article><p>a <math><mi>x</mi></math> b</p><svg><text>drawn</text></svg><noscript>plain</noscript><select><option>no</option></select><textarea>no</textarea></article>"
    assert html_extract.extract([math]) == ["a x b\n\ndrawnplain"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """All stages on null and empty texts, repeated rows, extra columns and an empty table."""
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, f"document {i} speaks of {'apples and pears ' * (i % 3 + 1)} and number{i} more", "en" if i < 30 else None, f"s{i % 2}", 1) for i in range(40)]
    rows += [(50, None, "en", None, 0), (51, "", None, "s", 0), (52, "²", None, "s", 0), (None, "no id at all here", "en", "s0", 1), (60, f"x {bench} y", "en", "s1", 1), (61, rows[3][1], "en", "s1", 1), (61, rows[3][1], "en", "s1", 1)]
    df = docs(spark, rows).withColumns({"row": F.lit(1), "shard": F.lit("x"), "text2": F.col("text")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs(spark, [(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(df.columns) and {f.name for f in spark.read.parquet(str(tmp_path / "documents.parquet")).schema} == set(out.columns)
    got = {r.doc_id: r.shard for r in out.collect()}
    assert not {50, 51, 52, 60, 61} & set(got) and all(s.startswith("shard-") for s in got.values()) and set(got) <= {r[0] for r in rows}
    names = df.columns
    stage = df
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, df.limit(0), str(tmp_path))
        assert empty.count() == 0 and set(empty.columns) == set(names), name
        if name in ("language_id", "near_duplicates", "benchmark"):
            stage = f(spark, stage, str(tmp_path))
    assert {r.doc_id for r in stage.select("doc_id").collect()} == {*range(40), None}
