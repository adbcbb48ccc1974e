from __future__ import annotations

import corpus_pipeline
from kinetable.llm import pieces, rules
from kinetable.llm.queries import VOCABULARY_FILE
from test_similar import brute as one_of_each
from test_suffixes import brute as without_repeats

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_like_brute_force(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(docs)
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns or i == 4
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    text = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in rules.quality_rules(seen[0], ["doc_id"]).where("kept").collect()}
    assert {d for d, _ in text(seen[1])} == kept and len(kept) < seen[0].count()
    assert {d for d, _ in text(seen[2])} == one_of_each(text(seen[1]))
    want = without_repeats(text(seen[2]))
    assert {d: t for d, t in text(seen[3])} == {d: t.decode("utf-8", "ignore") for d, t in want.items()}
    own = pieces.encoder(VOCABULARY_FILE).vocabulary
    back = sorted((r.doc_id, pieces.decode(r.ids, own)) for r in docs.collect())
    assert back == sorted(text(seen[4]))


def test_stages_take_empty_tables_and_null_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, root string, __times int"
    for k, rows in enumerate(([], [(None,) * 7] * 3 + [(1, "word " * 70, None, None, None, None, None)])):
        docs = spark.createDataFrame(rows, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, FOLDER).write.parquet(str(tmp_path / f"{k}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{i}"))
        assert "root" in docs.columns


def test_last_stage_decodes(spark):
    name, stage = corpus_pipeline.STAGES[-1]
    assert "decoding" in name
    rows = [(1, "two  words ▁ \U0001f600"), (2, ""), (3, None)]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert len(out) == 3 and all(r.round_trip for r in out)
