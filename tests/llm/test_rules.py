from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, table
from kinetable.llm import rules

COLUMNS = "doc_id long, text string, lang string, __row int, __words string"


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", "  \n\t ", "a b c a b c", "x " * 500, "a a a a", "é ü\nb\n\nb\n b\nb ", "a|b <c> #d $5 %&*",
    "one two three four one two three\vfive\fsix", "the of and " * 40, "w" * 5000, "  nbsp em",
]


def test_base_counts_like_brute_force(spark):
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, COLUMNS), ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_divergence_parts_prose_from_symbols(spark):
    prose = [(i, " ".join(f"the wab{i}c{k} of yes{k} and to xen{k}{chr(97 + k % 26)} in" for k in range(20)), "en", 1, "") for i in range(30)]
    odd = [(100, " ".join(f"the%%% w{k}*** of&&& q{k}### is$$$" for k in range(20)), "en", 1, "")]
    df = spark.createDataFrame(prose + odd, COLUMNS)
    got = {r.doc_id: r for r in rules.quality_rules(df, ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(30)) and not got[100].kept and not got[100].base_failed
    kept = rules.kept_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(30))


def test_empty_table_and_null_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert rules.quality_rules(empty, ["doc_id"]).count() == rules.kept_documents(empty).count() == 0
    row = spark.createDataFrame([(None, "word " + " ".join(map(str, range(60))), None, None, None)] * 2, COLUMNS)
    assert [r.n_words for r in rules.quality_rules(row, ["doc_id"]).collect()] == [61, 61]


@pytest.mark.parametrize("name", ["op6_mix_sources", "op8_quality_rules"])
def test_against_sql(spark, name):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    result = db.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())
