from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetable.llm import queries, spellings

QUERIES = queries.QUERIES

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spellings.CAPITALS, spellings.SMALL)


def one_edit(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


def brute(counts, ratio=5):
    alphabet, out = sorted(set("".join(counts))), {}
    for word, n in counts.items():
        near = {w for w in one_edit(word, alphabet) if w != word and w in counts}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    rows = set()
    for word, (form, n, near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.add((word, form, root, n, near, form_n))
    return rows


def counted_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def of_query(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, str(tmp_path)).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("crowd", [2, 9, 64])
def test_near_words_against_all_single_edits(spark, crowd):
    random.seed(crowd)
    counts = {}
    for _ in range(1500):
        word = "".join(random.choice("abé") for _ in range(random.randint(6, 9)))
        counts[word] = random.choice([1, 2, 9, 60, 60, 400])
    counts |= {"x" * 40: 5, "x" * 41: 50, "x" * 42: 600, "x" * 20 + "y" + "x" * 20: 7}
    got = spellings.variants(spark.createDataFrame(list(counts.items()), "word string, n int"), crowd=crowd).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute(counts)


def test_lists_stay_small_and_hold_every_pair_once(spark):
    counts = {"q" * 10 + a + b + "z" * 10: 1 for a in "abcdefghijklm" for b in "abcdefghijklmnop"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    lists = spellings.lists_of_bounded_size(words, shortest=6, crowd=20)
    sizes = [r["count"] for r in lists.groupBy("key").count().collect()]
    assert max(sizes) <= 20
    got = {r.word: r.n_near for r in spellings.near_words(words, shortest=6, crowd=20).collect()}
    assert got == {w: 12 + 15 for w in counts}


def test_band_rows_against_a_whole_matrix():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    random.seed(3)
    words = sorted({"".join(random.choice("ab") for _ in range(random.randint(0, 6))) for _ in range(120)})
    got = set(spellings.near_in_list(words, list(range(len(words)))))
    assert got == {(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if distance(a, b) == 1}


def test_query_against_brute_force_on_the_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001").collect()]
    want = brute(counted_words(docs))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in want)


def test_query_on_nulls_repeats_case_and_long_texts(spark, tmp_path):
    docs = [(None, "Straße STRASSE strasse strasse strasse strasse strasses " * 30), (None, None), (1, ""), (2, "12 !"),
            (3, "ÀÉÎõü÷ " * 9 + "ÀÉÎõü÷a " * 70), (4, "strasseı " * 6), (5, "a" * 50_000 + " ")] + [(6, "kitten kittens " * 3)] * 4
    docs += [(7, "long" * 9_000), (7, "long" * 9_000 + "s")] * 6
    got = of_query(spark, docs, tmp_path)
    want = brute(counted_words(docs))
    assert len(got) == len(want) and set(got) == want


def test_empty_table(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == []


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(90)] + [("x", "w090")]
    got = spellings.roots(spark.createDataFrame(rows, "word string, form string"))
    assert got.count() == 91 and {r.root for r in got.collect()} == {"w090"}
    assert spellings.vocabulary(spark.createDataFrame([("abcdef",)] * 4, "word string")).where(F.col("n") > 0).count() == 0
