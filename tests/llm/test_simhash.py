from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kinetable.llm import components, simhash
from kinetable.settings import checkpointed


def brute_print(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in root:
        for q in root:
            if p < q and bin((p ^ q) & 2**64 - 1).count("1") <= bits:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_fingerprints_are_spark_hash_majorities(spark):
    texts = ["One two THREE four five six", "a b", "É ü ß x y z", "", None, "  ", "word " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % 2**64 for r in simhash.fingerprints(df, ["doc_id"]).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}
    assert spark.sql("select xxhash64('one two three four')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two three four", 42)


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_connect_like_all_pairs(spark, crowd):
    draw = random.Random(crowd)
    prints = [draw.getrandbits(64) - 2**63 for _ in range(60)]
    for p in prints[:20]:
        for _ in range(4):
            q = p
            for _ in range(draw.randint(1, 6)):
                q ^= 1 << draw.randrange(63)
            prints.append(q)
    prints = sorted(set(prints))
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), bits=4, crowd=crowd)
    roots = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    assert {p: roots.get(p, p) for p in prints} == brute_groups(prints, 4)


def test_keys_are_not_broadcast_for_as_small_as_their_fingerprints(spark, monkeypatch):
    plans = []

    def seen(df):
        run = df._jdf.queryExecution()
        run.toRdd().count()
        plans.append(run.executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(simhash, "checkpointed", seen)
    prints = spark.range(20_000).select(F.xxhash64("id").alias("fingerprint")).distinct()  # 0.3 MB, the keys 35 times as many
    simhash.links(prints)
    assert "Generate" in plans[0] and "isFinalPlan=true" in plans[0] and "BroadcastExchange" not in plans[0]


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 90)], "a long, b long")
    got = {r.node: r.root for r in components.components(chain, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    assert components.components(chain.limit(0), "a", "b").count() == 0


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 1), (2, "A B C d e", 2), (None, None, 3), (9, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = simhash.near_duplicates(df, ["doc_id"], order="doc_id").collect()
    assert sorted(((r.doc_id, r.component) for r in got), key=repr) == [(2, 2), (5, 2), (5, 2), (9, 9), (None, 9)]
    assert simhash.near_duplicates(df.limit(0), ["doc_id"], order="doc_id").count() == 0
