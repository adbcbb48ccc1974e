"""Spelling variants: words one edit apart, each grouped under its common form.

The vocabulary is searched by dynamic programming over sorted lists. Two words
with one inserted, deleted or replaced character agree on both sides of it, so
they agree outside of one *window* of positions that holds the edit. Words that
agree outside of a window form a list. The windows of one length split the
positions, and a pair counts only in the window that holds its first difference:
every pair is found once, whatever the windows. A list starts with half of the
positions as its window; lists of over ``crowd`` words are dealt anew with half
the window, down to one position, where the alphabet bounds them. So no task
gets a list that grows with the vocabulary, and no pair is lost.

In a list, each word is matched against the words in sorted order. The edit
matrix has three cells a row, the band of one edit; rows stay as far as the next
word shares its beginning (LCP) with the one before, and a beginning that is
over one edit away skips all words that share it.

Defined results: null and empty texts have no words; repeated rows count again;
words of any length are matched; an empty table gives an empty result. The form
of a word is its near word of largest count, of equal ones the smallest in
code-point order; forms grow in count by ``ratio``, so chains of them end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.settings import checkpointed

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"
FIRST_ROW = (9, 0, 1)  # cells one before, on and one after the diagonal; 9 is out of reach


def letter_runs(text: Column, pattern: str = LETTERS) -> Column:
    """Maximal runs of letters as an array, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(pattern), F.lit(0))


def next_row(row: tuple[int, int, int], char: str, word: str, depth: int) -> tuple[int, int, int]:
    """The band of the edit matrix after one more character of the listed word, the ``depth``-th from 0."""
    before, on, after = row
    n = len(word)
    if not (0 < depth <= n and word[depth - 1] == char):
        before += 1
    low = before if before <= on else on + 1
    if not (depth < n and word[depth] == char):
        on += 1
    middle = min(on, after + 1, low + 1)
    if not (depth + 1 < n and word[depth + 1] == char):
        after += 1
    return low, middle, after if after <= middle else middle + 1


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def near_in_list(words: list[str], picked: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs (picked, listed) of places in a sorted list of different words that are one edit apart."""
    count = len(words)
    shared = [0] + [common_prefix(words[i - 1], words[i]) for i in range(1, count)]
    for q in picked:
        word, rows, i, known = words[q], [FIRST_ROW], 0, 0
        n = len(word)
        while i < count:
            listed = words[i]
            known = min(known, shared[i])
            del rows[known + 1:]
            row, dead = rows[-1], False
            for depth in range(known, len(listed)):
                row = next_row(row, listed[depth], word, depth)
                rows.append(row)
                if min(row) > 1:
                    dead = True
                    break
            known = len(rows) - 1
            if not dead:
                at = n - len(listed) + 1
                if i != q and 0 <= at <= 2 and row[at] == 1:
                    yield q, i
            i += 1
            if dead:  # the range that shares the beginning up to the dead row
                while i < count and shared[i] >= known:
                    i += 1


def _windows(lo: Column, hi: Column, size: Column) -> Column:
    """The two halves of a window of positions."""
    middle = F.floor((lo + hi) / 2).cast("int")
    half = lambda a, b: F.struct(size.alias("size"), a.alias("lo"), b.alias("hi"))
    return F.array(half(lo, middle), half(middle, hi))


def _posted(words: DataFrame, shortest: int) -> DataFrame:
    """Every word in the lists of its own length and as the longer one of a pair, each with two windows."""
    n, start = F.length("word"), F.lit(0)
    own = _windows(start, n + 1, n)
    longer = F.when(n > shortest, _windows(start, n, n - 1)).otherwise(F.expr("array()").cast(
        "array<struct<size: int, lo: int, hi: int>>"))
    return words.select("word", "n", F.explode(F.concat(own, longer)).alias("w")).select("word", "n", "w.*")


def _counted(posts: DataFrame) -> DataFrame:
    """Posts of lists that can hold a pair, with a key of the list and its length."""
    tail = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    keyed = posts.withColumn("key", F.xxhash64(
        "size", "lo", "hi", F.expr("substring(word, 1, lo)"), F.when(tail > 0, F.substring("word", -tail, tail)).otherwise("")))
    lists = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.max((F.length("word") == F.col("size")).cast("int")).alias("own"))
    return keyed.join(lists.where("members > 1 AND own = 1").drop("own"), "key")


def lists_of_bounded_size(words: DataFrame, *, shortest: int, crowd: int) -> DataFrame:
    """Posts ``(key, word, n, size, lo, hi)`` whose lists have at most ``crowd`` words or a window of one position."""
    ready, posts = None, _posted(words, shortest)
    while True:
        now = checkpointed(_counted(posts))
        large = (F.col("members") > crowd) & (F.col("hi") - F.col("lo") > 1)
        done = now.where(~large).drop("members")
        ready = done if ready is None else ready.unionByName(done)
        rest = now.where(large)
        if rest.isEmpty():
            return ready
        posts = rest.select("word", "n", F.explode(_windows(F.col("lo"), F.col("hi"), F.col("size"))).alias("w")).select(
            "word", "n", "w.*")


_FOUND = "word string, n_near long, near string, near_n long"


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within each list; rows come sorted by list and word."""

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    out: list[tuple] = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        out += _of_list(list(group))
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("word", "n_near", "near", "near_n"), (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _of_list(members: list[tuple]) -> list[tuple]:
    """What each word of a list is near to: its number of near words and the best of them."""
    # outside of the window all are equal; a key that two lists share by chance is taken apart
    lists: dict[tuple, list[int]] = {}
    for i, (_, word, _, *window) in enumerate(members):
        end = len(word) - max(window[0] - window[2], 0)
        lists.setdefault((*window, word[:window[1]], word[end:]), []).append(i)
    out = []
    for (size, lo, hi, *_), places in lists.items():
        tail = max(size - hi, 0)
        parts = [members[i][1][lo:len(members[i][1]) - tail] for i in places]
        picked = [k for k, i in enumerate(places) if len(members[i][1]) == size]
        best: dict[int, list] = {}
        for q, k in near_in_list(parts, picked):
            if len(parts[k]) != len(parts[q]):
                if common_prefix(parts[q], parts[k]) >= hi - lo:
                    continue  # the first difference is in a later window
                _add(best, places, members, k, q)
            _add(best, places, members, q, k)
        out += [(members[places[q]][1], n, word, -count) for q, (n, (count, word)) in best.items()]
    return out


def _add(best: dict[int, list], places: list[int], members: list[tuple], q: int, k: int) -> None:
    _, word, count, *_ = members[places[k]]
    had = best.setdefault(q, [0, (1, "")])
    had[0] += 1
    had[1] = min(had[1], (-count, word))


def near_words(words: DataFrame, *, shortest: int = 1, crowd: int = 64) -> DataFrame:
    """``word``, ``n_near``, ``near`` and ``near_n`` of the words that have a near one.

    ``words`` has ``word`` (distinct, not null) and ``n``; words under ``shortest`` code points are not compared.
    """
    words = words.where(F.length("word") >= shortest).select("word", F.col("n").cast("long").alias("n"))
    lists = lists_of_bounded_size(words, shortest=shortest, crowd=crowd)
    ordered = lists.select("key", "word", "n", "size", "lo", "hi").repartition("key").sortWithinPartitions("key", "word")
    found = ordered.mapInArrow(_matched, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms of each word end; ``forms`` has ``word`` and ``form``, without cycles.

    Each round follows twice as many forms, so a chain of n takes log2(n) of them.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(on, "root", "left")
        later = checkpointed(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = later.drop("moved")
        if later.where("moved").isEmpty():
            return now


def variants(words: DataFrame, *, shortest: int = 6, ratio: int = 5, crowd: int = 64) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of a counted vocabulary."""
    words = checkpointed(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, shortest=shortest, crowd=crowd)
    formed = F.col("near_n") >= ratio * F.col("n")
    placed = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    ends = roots(placed.where("form IS NOT NULL"))
    return placed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(runs: DataFrame, *, shortest: int = 6, least: int = 5) -> DataFrame:
    """Counted distinct words of a column ``word``, one row an occurrence."""
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least)


def misspelt_runs(docs: DataFrame, *, order: str = "doc_id", text: str = "text", shortest: int = 6, every: int = 199) -> DataFrame:
    """``word`` of every letter run; of each run that ``every`` divides by its checksum, one character is gone.

    Runs too short for a word are left out. A null id is written as nothing.
    """
    run = docs.select(F.coalesce(F.col(f"`{order}`").cast("string"), F.lit("")).alias("id"),
                      F.explode(letter_runs(F.col(f"`{text}`"))).alias("run")).where(F.length("run") >= shortest)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    gone = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return run.withColumn("h", h).select(
        F.when(F.col("h") % every == 0, gone).otherwise(F.col("run")).alias("word"))
