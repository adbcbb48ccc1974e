from __future__ import annotations

import math

from kinetable.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def corpus(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", None][min(3, i % 10 // 3)], 1, "x") for i in range(400)]
    rows += [(1000, None, "d", 1, None), (1001, "  ", "d", None, "y"), (1002, "z " * 5000, "e", 1, "z")]
    return docs(spark, rows), rows


def brute_targets(sizes, epochs=3):
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in held)
        level = rest / (sum(weight[s] for s in sizes if s not in held) or 1)
        more = {s for s in sizes if s not in held and level * weight[s] > epochs * sizes[s]}
        if not more:
            return {s: float(epochs * sizes[s]) if s in held else level * weight[s] for s in sizes}
        held |= more


def test_targets_and_what_is_taken(spark):
    df, rows = corpus(spark)
    sizes, taken = {}, {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    got = mixing.mixed(df, ["doc_id"]).collect()
    of = {r[0]: r[2] for r in rows}
    largest = {s: max(r.size for r in got if of[r.doc_id] == s) for s in sizes}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s]) and 0 <= r.times <= 3
        taken[s] = taken.get(s, 0) + r.times * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s
    again = mixing.mixed(df.repartition(7), ["doc_id"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_whole_rows_repeat_as_counted(spark):
    df, _ = corpus(spark)
    times = {r.doc_id: r.times for r in mixing.mixed(df, ["doc_id"]).collect()}
    out = mixing.repeated(df, ["doc_id"])
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in times.items() if n}


def test_empty_nothing_to_say_and_equal_rows(spark):
    assert mixing.mixed(docs(spark, []), ["doc_id"]).count() == 0
    got = mixing.mixed(docs(spark, [(1, None, None, 1, ""), (2, "", "a", 1, "")]), ["doc_id"]).collect()
    assert {(r.size, r.target) for r in got} == {(0, 0.0)}
    same = mixing.mixed(docs(spark, [(None, "a b", "s", 1, "")] * 4), ["doc_id"]).collect()
    assert sum(r.times for r in same) == 4


def test_equal_rows_are_taken_up_to_the_target(spark):
    """A hundred equal rows and others: the target lies in the middle of the equal ones."""
    rows = [(None, "a b c d e f g h i j", "s", 1, "")] * 100 + [(i, "w " * 37, "t", 1, "") for i in range(30)] + [(7, "x " * 5, "u", 1, "")] * 40
    df = docs(spark, rows).repartition(5)
    got = mixing.mixed(df, ["doc_id"]).collect()
    sizes = {"s": 1000, "t": 1110, "u": 200}
    want, taken = brute_targets(sizes), {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.times * r.size
        assert 0 <= r.times <= 3
    for s, largest in (("s", 10), ("t", 37), ("u", 5)):
        assert abs(taken[sizes[s]] - want[s]) <= largest / 2 + 1, (s, taken, want)
    assert mixing.repeated(df, ["doc_id"]).count() == sum(r.times for r in got)
