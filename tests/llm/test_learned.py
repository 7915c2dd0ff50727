"""Language identification, main text and nearest neighbours: held-out accuracy and recall."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_content, language, queries
from tessera.llm.arrays import text_buffers

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{LARGER}/documents.parquet"))


def test_held_out_languages(spark, model):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.98


def test_language_of_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "日本語"), (None, "the and of that"), (6, "the"), (6, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1))
    got = {(r.doc_id, i): r for i, r in enumerate(language.predict(docs, model, True).collect())}
    by = {k[0]: r for k, r in got.items()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].score == 0 and by[None].held_out is False and len(got) == 7
    assert language.predict(docs.limit(0), model).collect() == []
    assert language.keep_identified(docs.select("doc_id", "text"), model, 0.2).count() == 3
    none = language.train(docs.filter("false"))
    assert none.languages == [] and {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_mixed_text_has_spans(spark, model):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").filter("length(text) > 400")
    a, b = (docs.filter(F.col("lang") == x).orderBy("doc_id").first().text[:300] for x in ("de", "fr"))
    spans = language.predict(spark.createDataFrame([(1, a + " . " + b)], "doc_id long, text string"), model, True).first().spans
    assert {s["lang"] for s in spans} >= {"de", "fr"}
    size = len(a.encode())
    assert sum(s["end"] - s["start"] for s in spans if s["lang"] == "de" and s["end"] <= size + 30) > 0.7 * size


def test_viterbi_matches_brute_force():
    r = np.random.default_rng(2)
    score = r.normal(0, 3, (9, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 9])
    got, _ = language.viterbi(score, first, 2.0)
    for a, b in ((0, 4), (4, 9)):
        best = max(np.ndindex(*(3,) * (b - a)), key=lambda s: sum(score[a + i, x] for i, x in enumerate(s)) - 2.0 * sum(x != y for x, y in zip(s, s[1:], strict=False)))
        assert got[a:b].tolist() == list(best)


def test_two_hundred_languages(spark):
    r = np.random.default_rng(1)
    sound = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(200)]
    rows = [(i, " ".join(sound[i % 200] + r.choice(list("xyz")) for _ in range(30)), f"l{i % 200:03}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(model.languages) == 200 and np.mean([x.lang == x.lang_pred for x in got]) > 0.99


def test_scripts_exclude_languages(spark):
    """A Greek word between Latin ones is not labelled with a language that is never written in Greek letters."""
    rows = [(i, "the cat sat on the mat", "en") for i in range(40)] + [(100 + i, "η γάτα κάθεται στο χαλί", "el") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "the cat sat on γάτα mat on the cat 日本 sat"
    runs = language.letter_runs(*text_buffers(pa.array([text])))
    label, known = language.label_words(model, runs)
    names = [model.languages[x] for x in label]
    assert names[4] == "el" and names[:4] + names[5:9] == ["en"] * 8 and known.tolist() == [True] * 9 + [False, True]


def test_long_texts_in_blocks(spark, model, monkeypatch):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").orderBy("doc_id").limit(60)
    whole = sorted(tuple(r) for r in language.predict(docs, model).collect())
    texts = pa.array([r.text for r in docs.collect()])
    before = language._predict(model, texts)
    monkeypatch.setattr(language, "BLOCK_WORDS", 50)
    after = language._predict(model, texts)
    assert before[0] == after[0] and np.allclose(before[1], after[1], atol=0.05) and len(whole) == 60


def test_marginals_match_brute_force():
    page = html_content.parse("<body><div class=ad><p>a</p></div><article><p>b</p></article></body>")
    m = html_content.default_model()
    f = html_content.forest([page], m.index)
    p, _ = html_content.marginals(f, m.weight, m.pair)
    n = len(f.parent)
    own = np.bincount(f.row, m.weight[f.feature], n)
    total, on = 0.0, np.zeros(n)
    for s in np.ndindex(*(2,) * n):
        w = np.exp(sum(own[i] * s[i] for i in range(n)) + sum(m.pair[f.kind[i], s[f.parent[i]], s[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        on += w * np.array(s)
    np.testing.assert_allclose(p, on / total, rtol=1e-6)


def test_held_out_pages():
    m = html_content.default_model()
    made = [html_content.labelled_page(i) for i in range(5000, 5200)]
    got = html_content.extract([s for s, _ in made], m)
    assert np.mean([g == "\n".join(b) for g, (_, b) in zip(got, made, strict=True)]) > 0.9


def test_pages_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_text_after_raw_elements():
    text = lambda s: [t for t in html_content.parse(s).text if t]
    for icon in ("<svg/>", "<svg />", "<SVG class=i />", "<svg class='i'/>", '<svg viewBox="0 0 1 1" hidden/>', "<math/>"):
        assert text(f"<body><p>one {icon}two</p><p>three</p>") == ["one two", "three"]
        assert text(f"<body><p>one {icon}two</p><svg><text>no</text></svg><p>three</p>") == ["one two", "three"]
    assert text("<body><p>one<svg class=i/><text>no</text></svg></p><p>two</p>") == ["one", "two"]
    for name in ("script", "STYLE", "svg"):
        assert text(f"<body><p>\u0130stanbul \u0130\u0130</p><{name}>var a</{name.swapcase()} ><p>two</p>") == ["\u0130stanbul \u0130\u0130", "two"]
    assert text("<body><script>a </scripts> b</script><p>two</p>") == ["two"]


def test_unclosed_tags_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        page = html_content.parse("<p>" + "<b>x <a href=y>z" * n)
        took.append(time.perf_counter() - began)
        assert len("".join(t for t in page.text if t)) == 3 * n
    assert took[1] < 12 * took[0]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<article><p>a &lt; b<p>c&amp;<br>d  e<script>x</script></article><!-- "), (None, "u", "<article><p>x</p></article>"), (5, "u", "<p" * 500), (6, "u", "<div>" * 3000 + "t")]
    rows += [(7, "u", "<nav><a href=/>menu</a></nav><article><h1>T</h1><p>one</p><div class='ad'>buy</div><p>two</p></article><div id=comments><p>nice</p></div>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    m = html_content.default_model()
    got = html_content.main_text(df, m).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == "" and by[4] == "a < b\nc& d e" and by[None] == "x" and by[7] == "T\none\ntwo"
    assert html_content.main_text(df.limit(0), m).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = ann.nearest(spark, df).collect()
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    true = {(ids[a], ids[b]) for a, row in zip(q, np.argsort(-s, axis=1)[:, :20], strict=True) for b in row}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) / len(true) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12 for r in got)
    for query in {r.query_id for r in got}:
        own = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == query)
        assert [o[0] for o in own] == list(range(1, 21)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_odd_vectors(spark):
    rows = [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (40, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (6, [None, 2.0]), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.5]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("score", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(spark, df).collect())
    assert got == [(20, 1, 40, 1.0), (20, 2, 7, 0.5), (20, 3, 9, 0.5), (40, 1, 20, 1.0), (40, 2, 7, 0.5), (40, 3, 9, 0.5)]
    assert ann.nearest(spark, df.limit(0)).collect() == []
    assert ann.nearest(spark, df.filter("vec_id = 7")).collect() == []


def test_hot_vector_and_blocks(spark, monkeypatch):
    """A third of all rows are one vector; parts are dealt into many blocks. Ties go to the least ids."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 10)
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for row in ann.nearest(spark, df).collect():
        got.setdefault(row.query_id, {})[row.rank] = row.vec_id
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    hits = total = 0
    for q, found in got.items():
        s[q, q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s[q], 9)))[:20]
        hits += len(set(want) & set(found.values()))
        total += 20
        if q % 3 == 0:
            best = [found[k] for k in sorted(found)]
            same = [b for b in best if b % 3 == 0]
            assert same == sorted(same)
    assert hits / total >= 0.9 and len(got) == 75


def test_repeated_rows_lose_no_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(100, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 40 + [(9, x[11].tolist())] * 3 + [(9, x[12].tolist())]
    got = {}
    for row in ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=1.0).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    for q, found in got.items():
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -9e9), float(x[q].astype(float) @ np.array(v, np.float32).astype(float)))
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:20]
        found.sort()
        assert [f[1] for f in found] == [w[0] for w in want] and np.allclose([f[2] for f in found], [w[1] for w in want], atol=1e-12)
    assert sorted(got) == [0, 20, 40, 60, 80]


def test_double_vectors_keep_their_precision(spark):
    rows = [(20, [1.0, 1e-12]), (1, [1.0, 2.0]), (2, [1.0, 1.0]), (3, [1.0, 3.0])]
    got = sorted((r.rank, r.vec_id) for r in ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 3), (2, 1), (3, 2)]


def test_vectors_with_neighbourhoods_visit_few_rows(spark):
    """600 bunches: recall of 0.9 at less than a fifth of the rows."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(600, 32))
    x = centre[r.integers(0, 600, 20000)] + 0.35 * r.normal(size=(20000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    report = {}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(row.query_id, row.vec_id) for row in ann.nearest(spark, df, report=report).collect()}
    q = np.arange(0, 20000, 20)
    s = x[q].astype(np.float64) @ x.T
    s[np.arange(len(q)), q] = -np.inf
    true = {(int(a), int(b)) for a, row in zip(q, np.argsort(-s, axis=1)[:, :20], strict=True) for b in row}
    visited = ann.route(spark.createDataFrame([(int(i), x[i].tolist()) for i in q], "id long, vec array<float>"), ann.fit(np.unique(x[::4][:4480], axis=0), report["parts"]), report["share"]).count() / len(q) / report["parts"]
    assert len(true & got) / len(true) >= 0.9 and report["parts"] == 35 and visited <= 0.2, (len(true & got) / len(true), report, visited)


def test_balanced_parts():
    x = np.random.default_rng(4).normal(size=(800, 16)).astype(np.float32)
    label = ann.balanced_parts(x, ann.neighbour_graph(x), 5)
    assert np.bincount(label, minlength=5).max() <= np.ceil(1.05 * 160) + 1
    assert pa.array(label).null_count == 0
