"""Quality rules: base counts of a text, and how far its character classes and
common words lie from those of a language, by Jensen-Shannon distance.

Only DataFrame functions. One pass over the texts gives each row its counts,
which are small and written once; the language references are sums over all of
them, and the verdict is arithmetic on the counts.

Defined results: a null or empty text has no words and fails the base rules;
rows that repeat are judged each; an empty table gives an empty result; other
columns are left alone and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import words
from kinetable.settings import checkpointed

# fixed values: frequent function words of the languages that have a reference
COMMON_WORDS = {
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an dem im".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this or from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au il ne pas avec".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()"
CLASSES = ("digits", "upper", "punctuation", "symbols", "other")


@dataclass(frozen=True)
class Limits:
    """Where the rules cut. Distances are between 0 (same) and 1 (nothing shared)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.28
    word_distance: float = 0.45
    word_guard: int = 50  # common words are judged from so many words on


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the two histograms as columns ``__...``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__words", words(F.col(text)))
    rows = rows.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
        "__lines": F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
        "__windows": F.when(F.size("__words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        )).otherwise(F.array().cast("array<bigint>")),
        "__common": F.filter("__words", lambda w: w.isin(VOCABULARY)),
        "__digits": F.length(F.regexp_replace(t, "[^0-9]+", "")),
        "__upper": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")),
        "__punctuation": F.length(F.regexp_replace(t, "[^.,;:!?\"'()]+", "")),
    })
    rows = rows.withColumns({
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_repeat_words": _repeated("__windows"),
        "__other": F.col("__word_chars") - F.col("__digits") - F.col("__upper")
        - F.col("__punctuation") - F.col("__n_symbols"),
    })
    return rows.withColumns({
        "__classes": F.array(*[F.col(c).cast("long") for c in (
            "__digits", "__upper", "__punctuation", "__n_symbols", "__other")]),
        "__vocabulary": F.transform(F.lit(VOCABULARY), lambda w: (
            F.size("__common") - F.size(F.array_remove("__common", w))).cast("long")),
    }).drop("__words", "__lines", "__windows", "__common", "__digits", "__upper", "__punctuation", "__other")


def _repeated(windows: str) -> Column:
    """Positions covered by a window that occurs more than once, each counted once.

    All windows are sorted as one number: the leading bits of the hash, then the
    position. Those that share leading bits with a neighbour are sorted again by
    their whole hash, and equal neighbours there are the repeated ones.
    """
    position = (1 << 28) - 1
    packed = F.sort_array(F.transform(
        windows, lambda h, i: h.bitwiseAND(F.lit(~position)).bitwiseOR(i.cast("long"))))
    head = lambda x: F.shiftright(x, 28)
    near = lambda a: F.filter(a, lambda x, j: (head(x) == F.coalesce(head(F.get(a, j - 1)), head(x) + 1))
                              | (head(x) == F.coalesce(head(F.get(a, j + 1)), head(x) + 1)))
    whole = lambda a: F.sort_array(F.transform(a, lambda x: F.struct(
        F.get(windows, x.bitwiseAND(F.lit(position)).cast("int")).alias("h"),
        x.bitwiseAND(F.lit(position)).alias("i"))))
    equal = lambda a: F.filter(a, lambda s, j: F.coalesce(s.h == F.get(a, j - 1).h, F.lit(False))
                               | F.coalesce(s.h == F.get(a, j + 1).h, F.lit(False)))
    places = lambda a: F.sort_array(F.transform(a, lambda s: s.i))
    width = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), x - F.coalesce(F.get(p, j - 1), x - 3))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    return F.when(F.size(windows) < 2, F.lit(0).cast("long")).otherwise(
        _let(packed, lambda a: _let(near(a), lambda b: F.when(F.size(b) == 0, F.lit(0).cast("long")).otherwise(
            _let(whole(b), lambda c: _let(equal(c), lambda d: _let(places(d), width)))))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def references(rows: DataFrame, lang: str = "lang", guard: int = 50) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word distributions of each language with a word list, over all rows.

    The result has one line per listed language, whatever the size of the table.
    """
    known = rows.where(F.col(lang).isin(list(COMMON_WORDS)) & (F.col("__n_words") >= guard))
    sums = known.groupBy(lang).agg(
        *[F.sum(F.get("__classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.get("__vocabulary", F.lit(i))).alias(f"v{i}") for i in range(len(VOCABULARY))],
        F.sum("__n_words").alias("n"))
    result = {}
    for row in sorted(sums.collect(), key=lambda r: r[0]):
        classes = [row[f"c{i}"] for i in range(len(CLASSES))]
        found = [row[f"v{i}"] for i in range(len(VOCABULARY))]
        found.append(row["n"] - sum(found))
        result[row[0]] = ([x / max(1, sum(classes)) for x in classes], [x / row["n"] for x in found])
    return result


def divergence(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts to a distribution, base 2: 0 to 1.

    With m the mean of p and q, each bin adds (p log p + q log q) / 2 - m log m.
    """
    logs = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    share = lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0))
    term = lambda c, q: (logs(share(c)) + logs(q)) / 2 - logs((share(c) + q) / 2)
    bins = F.zip_with(counts, F.lit([float(q) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(bins, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judged(rows: DataFrame, refs: dict, limits: Limits = Limits()) -> DataFrame:
    """Add distances, ``__base_failed`` and ``__kept`` to counted rows.

    A text is compared with every reference and takes the nearest, so a wrong or
    missing language label does not count against it. Without any reference the
    base rules alone decide.
    """
    base = (F.col("__n_words") < limits.min_words) | (
        100 * F.col("__n_repeat_words") > limits.max_repeat_percent * F.col("__n_words"))
    total = F.aggregate("__vocabulary", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumns({
        "__base_failed": base,
        "__found": F.concat("__vocabulary", F.array(F.col("__n_words") - total)),
    })
    nearest = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(0.0)
    rows = rows.withColumns({
        "__class_distance": nearest([divergence(F.col("__classes"), F.col("__word_chars"), c) for c, _ in refs.values()]),
        "__word_distance": nearest([divergence(F.col("__found"), F.col("__n_words"), w) for _, w in refs.values()]),
    })
    far = (F.col("__class_distance") > limits.class_distance) | (
        (F.col("__n_words") >= limits.word_guard) & (F.col("__word_distance") > limits.word_distance))
    return rows.withColumn("__kept", ~F.col("__base_failed") & ~far)


def quality_rules(
    docs: DataFrame, keys: list[str], *, text: str = "text", lang: str = "lang", limits: Limits = Limits()
) -> DataFrame:
    """One row per document: its keys, the base counts, both distances and the verdict."""
    slim = docs.select(
        *[F.col(f"`{k}`").alias(f"__key_{k}") for k in keys], F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    rows = checkpointed(counted(slim, "__text").drop("__text"))
    rows = judged(rows, references(rows, "__lang", limits.min_words), limits)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "class_distance", "word_distance")
    return rows.select(*[F.col(f"__key_{k}").alias(k) for k in keys], *[F.col(f"__{n}").alias(n) for n in names])


def kept_documents(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", limits: Limits = Limits()
) -> DataFrame:
    """The rows that pass, with all their columns as they are.

    The texts are read twice, once for the references and once for the verdict,
    and not moved.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col(f"`{text}`").alias("__text"), F.col(f"`{lang}`").alias("__lang"))
    refs = references(counted(rows, "__text"), "__lang", limits.min_words)
    rows = judged(counted(rows, "__text"), refs, limits)
    # a column that is no function of the row holds the filter back: pushed down, it would
    # repeat each step of the counts wherever the next one uses it
    rows = rows.withColumn("__part", F.spark_partition_id())
    return rows.where(F.col("__kept") & (F.col("__part") >= 0)).select("__row.*")
