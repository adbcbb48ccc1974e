from __future__ import annotations

import re

import corpus_pipeline


def test_every_operator_has_its_query_and_these_have_sql():
    numbers = sorted(int(m[1]) for name in corpus_pipeline.QUERIES if (m := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 14)) and "pipeline" in corpus_pipeline.QUERIES
    assert set(corpus_pipeline.CHECKS) == {"op6_mix_sources", "op8_quality_rules", "op12_warc_captures"}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "SentencePiece encoding and decoding"]
