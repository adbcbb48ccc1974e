from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from kinetable.llm import density, langid, licenses, urls
from kinetable.llm.queries import SITE_RULES

FOLDER = "/root/testdata/sf0.01"


def test_kernel_is_the_share_of_common_grams(spark):
    a, b = langid.gram_set("Ab ab"), langid.gram_set("ab")
    assert len(a) == 3 + 3 + 3 and len(b) == 3 + 3 + 2  # grams of " ab ab " and " ab "
    rows = spark.createDataFrame([(f"the of and to {i} is that was for with the", "en") for i in range(20)]
                                 + [(f"der die das und {i} ist nicht ein mit von", "de") for i in range(5)], "text string, lang string")
    model = langid.fit(rows)
    texts = ["the of and that", "der und nicht"]
    found = model.kernel(texts)
    for i, t in enumerate(texts):
        for j in range(found.shape[1]):
            assert 0 <= found[i, j] <= 1 + 1e-6
    assert [model.languages[k] for k in model.scores(texts).argmax(1)] == ["en", "de"]
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "the of and", None)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en" and 0 < got[4][1] <= 1
    assert langid.fit(rows.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_held_out_languages(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in entry.queries()["op1_language_id"](spark, FOLDER).collect() if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.98


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op7_quality_classifier"](spark, FOLDER).collect() if r.held_out and r.doc_id in labels]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    ahead = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert ahead > 0.85 and sum(s >= 0.7 for s in good) / len(good) > 0.9


def test_quality_without_labels_or_text(spark):
    none = spark.createDataFrame([], "text string, quality int")
    assert density.fit(none) is None
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert {r.score for r in density.scored(docs, None, ["doc_id"]).collect()} == {0.5}
    rows = spark.createDataFrame([(f"plain prose number {i} " * 9, 1) for i in range(30)]
                                 + [(f"### {i} $$$ %%% {i} " * 9, 0) for i in range(30)] + [(None, 1)], "text string, quality int")
    model = density.fit(rows)
    more = docs.union(spark.createDataFrame([(3, "plain prose number 99 " * 5), (4, "### 9 $$$ %%% 9" * 5)], docs.schema))
    got = {r.doc_id: r.score for r in density.scored(more, model, ["doc_id"]).collect()}
    assert got[3] > got[2] == got[1] > got[4] and all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("url, host, path, rule, action", [
    ("HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("https://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
    ("https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("https://a.net", "a.net", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("://#", "", "", None, None),
])
def test_rules(spark, url, host, path, rule, action):
    df = spark.createDataFrame([(1, url, "<p>some words here</p>", "h")], "page_id long, url string, html string, host string")
    r = urls.judged(df, SITE_RULES, ["page_id"]).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and (action is None or r.verdict == action)


def test_segments_and_verdicts(spark):
    words = urls.Segmenter({"cheap": 50, "pills": 40, "the": 900, "rapist": 1, "therapist": 20})
    assert words.split("cheappills") == ["cheap", "pills"] and words.split("therapist") == ["therapist"]
    assert words.split("qq") == ["qq"] and words.split("") == []
    page = "<script>var x</script><p>cheap pills casino royal news daily</p>"
    rows = [(i, f"http://cheappills{i}.com/buy", page) for i in range(5)] + [(10 + i, f"http://dailynews.com/{i}", page) for i in range(20)]
    rows += [(50, "http://royalcasino.org/x", page), (51, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judged(df, SITE_RULES, ["page_id"]).collect()}
    assert all(got[i].verdict == "block" for i in range(5)) and all(got[10 + i].verdict == "allow" for i in range(20))
    assert got[50].verdict == "block" and got[51].verdict == "allow"
    assert urls.judged(df.limit(0), SITE_RULES, ["page_id"]).count() == 0


def test_bayes_like_a_plain_count(spark):
    rows = [(["a", "b"], True), (["a"], True), (["b", "c"], False)]
    model = urls.fit(spark.createDataFrame(rows, "features array<string>, bad boolean"))
    assert math.isclose(model.odds["a"], math.log(3 / 6) - math.log(1 / 5))
    assert math.isclose(model.prior, math.log(3) - math.log(2))


def test_licenses(spark):
    text = "intro\nReleased under the MIT License.\nmore\nThis work is licensed under the GNU General Public License, version 2.\n"
    rows = [(1, text, "x"), (2, None, "x"), (3, "no such words", "x"), (4, "You need a driving licence to drive the old red truck", "x"), (1, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.line, r.license, r.lacking, r.added) for r in licenses.scan(df, ["doc_id"]).collect()), key=repr)
    assert got[:4] == sorted([(1, 1, "MIT", [], []), (1, 3, "GPL-2.0", [], [])] * 2, key=repr)
    assert [g[:3] for g in got[4:]] == [(4, 0, None)]
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def test_each_template_wins_for_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert scanner.winner(f"This file: {text}")[0] == name
        assert scanner.ranked(text)[0][0] > 0.3
