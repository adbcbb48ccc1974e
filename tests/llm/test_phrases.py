from __future__ import annotations

import hashlib
import random

import numpy as np

from kinetable.llm import phrases
from kinetable.llm.phrases import edited, fingerprints_with_next, likeness, sketches


def names_of(text, lowest=2):
    """All names, by a plain loop over one text at a time."""
    found, names, level = set(), [int(x) for x in phrases._mix(np.array([ord(c) for c in text], np.uint64) + phrases._A)], 0
    while names:
        if level >= lowest:
            found |= {int(phrases._mix(np.array([n + level & 2**64 - 1], np.uint64))[0]) >> 32 for n in names}
            if len(names) == 1:
                break
        runs = []
        for n in names:
            if runs and runs[-1][0] == n:
                runs[-1][1] += 1
            else:
                runs.append([n, 1])
        mix = lambda x: int(phrases._mix(np.array([x & 2**64 - 1], np.uint64))[0])
        names = [n if k == 1 else mix(n + int(phrases._A) * k) for n, k in runs]
        labels = names
        for _ in range(3):
            before = [labels[0] ^ 1, *labels]
            labels = [2 * (low := ((x ^ b) & -(x ^ b)).bit_length() - 1) + (x >> low & 1) for x, b in zip(labels, before)]
        heads = [0] + [i for i in range(2, len(names) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        parts = [names[a:b] for a, b in zip(heads, [*heads[1:], len(names)])]
        names = [mix(sum(mix(n + int(phrases._A) * (i + 1)) for i, n in enumerate(p))) for p in parts]
        level += 1
    return found


def test_names_like_a_plain_loop():
    draw = random.Random(3)
    texts = ["", "a", "ab", "aaaaaaa", "é😀" * 20, *["".join(draw.choice("abc de") for _ in range(draw.randint(1, 400))) for _ in range(30)]]
    with np.errstate(over="ignore"):
        for text, got in zip(texts, sketches(texts, keep=10**6)):
            assert set(got.tolist()) == names_of(text), text


def test_equal_substrings_share_names_at_any_offset():
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    shared = word(3000)
    a, b, c = sketches([word(137) + shared, word(71) + shared + word(200), word(3000)])
    assert likeness(a, b) > 0.7 and likeness(a, c) < 0.2 and likeness(a, a) == 1.0


def test_query_rows(spark):
    draw = random.Random(5)
    rows = [(i * 3, "".join(draw.choice("abcdé ") for _ in range(draw.randint(0, 300))), "x") for i in range(60)]
    rows += [(500, None, "x"), (501, "", None), (502, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range string")
    for pieces in (1, 7):
        got = {r.id: r for r in fingerprints_with_next(df, order="doc_id", pieces=pieces).collect()}
        assert len(got) == len(rows)
        for (i, text, _), (_, after, _) in zip(rows, [*rows[1:], rows[0]]):
            new = edited(text or "", after or "")
            r, (mine, its, following) = got[i], sketches([text or "", new, after or ""])
            assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert (r.fingerprint, r.edited_fingerprint) == (phrases.as_text(mine), phrases.as_text(its))
            assert (r.near_edited, r.near_next) == (likeness(mine, its), likeness(mine, following))


def test_one_row_repeats_and_nulls(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = fingerprints_with_next(df([(1, "only text")]), order="doc_id").collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    many = fingerprints_with_next(df([(1, "b"), (1, "b"), (1, "a"), (None, "c"), (None, None)]), order="doc_id").collect()
    assert len(many) == 5 and sum(r.id is None for r in many) == 2
    assert fingerprints_with_next(df([]), order="doc_id").count() == 0
