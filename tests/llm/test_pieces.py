from __future__ import annotations

import itertools
import random
import sys

import sentencepiece

from kinetable.llm import pieces
from kinetable.llm.queries import VOCABULARY_FILE

TEXTS = [
    "Hello, world", " two  blanks ", "line\nbreak\r\n\ttab", "▁ sign ▁▁ in text▁", "日本語 テキスト 😀 \0 \x07", "é" * 300,
    "x" * 1000, "a", " ", "the the the", "don't stop—now! (yes) [no] {maybe} #1 $2,000.50",
]


def test_round_trip_here_and_in_the_library(spark):
    own, library = pieces.encoder(VOCABULARY_FILE), sentencepiece.SentencePieceProcessor(model_file=VOCABULARY_FILE)
    for text in TEXTS:
        ids = own.encode(text)[0].tolist()
        assert pieces.decode(ids, own.vocabulary) == text
        if "▁" not in text and "\0" not in text:
            assert library.decode(ids) == text


def all_paths(text, v):
    """Every segmentation into pieces, for characters of the vocabulary."""
    out = []
    for n in range(len(text)):
        for cuts in itertools.combinations(range(1, len(text)), n):
            parts = [text[a:b] for a, b in zip((0, *cuts), (*cuts, len(text)))]
            if all(p in v.ids for p in parts):
                out.append((sum(v.score_of_id[v.ids[p]] for p in parts), [v.ids[p] for p in parts]))
    return sorted(out, key=lambda x: -x[0])


def test_nbest_like_all_segmentations():
    own = pieces.encoder(VOCABULARY_FILE)
    for text in ("▁thesea", "▁nation", "ering", "▁unhappy"):
        want = all_paths(text, own.vocabulary)
        got = pieces.Lattice(text, own.vocabulary).paths(8)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:8]]
        assert all((round(s, 6), ids) in [(round(t, 6), i) for t, i in want] for s, ids in got)


def test_batches_agree_with_single_lattices():
    own, draw = pieces.encoder(VOCABULARY_FILE), random.Random(1)
    texts = ["".join(draw.choice("abcdetnos ,.\n") for _ in range(draw.randint(0, 60))) for _ in range(80)]
    ids, sizes, score, loss = own.encode_all(texts)
    for k, text in enumerate(texts):
        best = own.nbest(text, 2)
        assert sizes[k] == len(own.encode(text)[0]) and abs(best[0][0] - score[k]) < 1e-6
        if len(best) > 1:
            assert abs(best[0][0] - best[1][0] - loss[k]) < 1e-4
    assert len(ids) == sizes.sum()


def test_nbest_of_a_text_joins_its_blocks():
    own = pieces.encoder(VOCABULARY_FILE)
    text = "the nation, so"
    lattice = pieces.Lattice("▁" + text.replace(" ", "▁"), own.vocabulary)
    assert [round(s, 6) for s, _ in own.nbest(text, 5)] == [round(s, 6) for s, _ in lattice.paths(5)]


def test_nulls_and_extra_columns(spark):
    rows = [(1, t, 7) for t in (*TEXTS[:3], None, "", "a", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = pieces.encoded(df, ["doc_id"], path=VOCABULARY_FILE)
    back = [r.text for r in pieces.decoded(found, ["doc_id"], path=VOCABULARY_FILE).collect()]
    assert sorted(back) == sorted(t or "" for _, t, _ in rows)
    assert pieces.encoded(df.limit(0), ["doc_id"], path=VOCABULARY_FILE).count() == 0


def test_next_best_of_whole_texts():
    own, draw = pieces.encoder(VOCABULARY_FILE), random.Random(9)
    texts = ["".join(draw.choice("abcdetnos ,.\n") for _ in range(draw.randint(0, 40))) for _ in range(60)] + TEXTS
    for count in (2, 5):
        (ids, sizes, score, loss), others = own.ranked_all(texts, count)
        ends = sizes.cumsum()
        for k, text in enumerate(texts):
            want = own.nbest(text, count)
            best = ids[ends[k] - sizes[k]:ends[k]].tolist()
            got = [(float(score[k]), best)] + [(s, i.tolist()) for s, i, same in others[k] if same]
            assert len(got) == len(want) and len({tuple(i) for _, i in got}) == len(got), text
            for (s, i), (t, _) in zip(got, want):
                assert abs(s - t) < 1e-3 and abs(own.vocabulary.score_of_id[i].sum() - s) < 1e-3
                assert pieces.decode(i, own.vocabulary) == text


def test_others_column(spark):
    rows = [(1, "the nation, so"), (2, None), (3, ""), (1, "the nation, so"), (4, "a" * 3000 + " b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pieces.encoded(df, ["doc_id"], path=VOCABULARY_FILE, verify=True, count=3).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    for r in got:
        scores = [r.score] + [o.score for o in r.others]
        assert scores == sorted(scores, reverse=True) and len(r.others) == (2 if r.doc_id in (1, 4) else 0)
        assert not r.others or abs(r.score - r.others[0].score - r.margin) < 1e-3
    assert pieces.encoded(df.limit(0), ["doc_id"], path=VOCABULARY_FILE, count=2).count() == 0


def test_pieces_of_a_batch_are_decoded_at_once():
    own = pieces.encoder(VOCABULARY_FILE)
    for texts in (TEXTS, ["", *TEXTS, "", "a  b", "a b "], [""], []):
        ids, sizes, _, _ = own.encode_all(texts)
        offsets = [0, *sizes.cumsum().tolist()]
        assert pieces.given_back(ids, offsets, texts, own.vocabulary) == [True] * len(texts)
        # a piece that is not the text's
        for k, text in enumerate(texts):
            if text:
                wrong = ids.copy()
                wrong[offsets[k + 1] - 1] = own.vocabulary.ids["z"]
                want = [j != k for j in range(len(texts))]
                assert pieces.given_back(wrong, offsets, texts, own.vocabulary) == want
    assert pieces.given_back(ids, [0, 0], ["x"], own.vocabulary) == [False]


def test_words_in_a_batch_are_solved_as_by_themselves():
    draw, v = random.Random(4), pieces.encoder(VOCABULARY_FILE).vocabulary
    words = ["".join(draw.choice("abcdetnos,.\n\té日😀\0") for _ in range(draw.randint(0, 12))) for _ in range(300)]
    words = list(dict.fromkeys([*words, "", "a." * 200, "x" * 300, "don't", "\n", "a\n"]))
    together = pieces.Encoder(v).solve_words(words)
    assert together == [pieces.Encoder(v).solve_words([w])[0] for w in words]
    own = pieces.Encoder(v)
    for word, part in zip(words, together):
        by_block = own.solve(list(set(v.blocks.findall("▁" + word))))
        assert part[4:] == b"".join(by_block[b][4:] for b in v.blocks.findall("▁" + word))
        assert part[:4] == pieces._joined([by_block[b] for b in v.blocks.findall("▁" + word)])[:4]
    # known ones, and those of the older half
    own = pieces.Encoder(v)
    own.solve_words(words[:100])
    own.older, own.words = (own.words, {}), {}
    own.solve_words(words[50:200])
    assert own.solve_words(words) == together


def test_calls_for_each_new_word_are_few():
    """Words of a batch are taken apart, looked up, solved and decoded in whole arrays."""
    draw = random.Random(6)
    texts = [" ".join("".join(draw.choice("abdehinorst") for _ in range(draw.randint(3, 12))) + draw.choice(("", "", ",", "%%"))
                      for _ in range(400)) for _ in range(10)]
    for batch in (texts, ["  " + t.replace(" ", "  ") + "  " for t in texts]):
        own, calls = pieces.Encoder(pieces.encoder(VOCABULARY_FILE).vocabulary), [0]

        def seen(frame, event, arg):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            own.ranked_all(batch, 2)
        finally:
            sys.setprofile(None)
        assert calls[0] < 8 * sum(len(set(t.split())) for t in texts)


def test_runs_of_blanks_belong_to_the_next_word():
    own, draw = pieces.encoder(VOCABULARY_FILE), random.Random(8)
    texts = ["".join(draw.choice("abet   ,.\né▁") for _ in range(draw.randint(0, 50))) for _ in range(150)]
    texts += [" ", "  ", "   a", "a   ", " a  b ", "\n  \n", "\udc80  a", *TEXTS]
    ids, sizes, score, loss = own.encode_all(texts)
    ends = sizes.cumsum()
    for k, text in enumerate(texts):
        by_block = [own.literal if b is None else own.solve([b])[b] for b in own.blocks(text)] if text else []
        assert ids[ends[k] - sizes[k]:ends[k]].tobytes() == b"".join(p[4:] for p in by_block), text
        assert not by_block or pieces.np.float32(loss[k]).tobytes() == pieces._joined(by_block)[:4]
        assert own.encode_all([text])[0].tolist() == ids[ends[k] - sizes[k]:ends[k]].tolist()
    assert pieces.given_back(ids, [0, *ends.tolist()], texts, own.vocabulary) == [True] * len(texts)
