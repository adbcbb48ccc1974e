"""Language identification with a string kernel.

Two texts are as alike as the sets of character n-grams (orders ``1`` to
``order``) they contain: the blended spectrum kernel on presence, normalised by
the sizes of both sets. ``landmarks`` training texts span the feature space
(Nyström): a text is its kernel values with them, whitened by their own kernel
matrix. One ridge regression for each language on +1/-1 targets is solved from
sums over the training rows, so any number of them can be used. Texts are
scored batch by batch as one matrix product.

The model is bounded by its parameters: the landmarks, whole texts of at most
``landmark_chars`` characters, and matrices of ``landmarks`` columns.

Defined results: null texts and those without a letter are ``und`` with score
zero; so is everything if no training row has a language. Rows that repeat get
equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts

UNKNOWN = "und"
_SPACE = np.array([0x20, 9, 10, 11, 12, 13], np.uint32)


def gram_set(text: str, order: int = 3) -> np.ndarray:
    """All different n-grams of a lower-cased text up to an order of three, each packed into one number.

    Runs of white space are one blank, and the text is set in blanks.
    """
    points = np.frombuffer(" ".join(text.lower().split()).join("  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.int64)
    grams, packed = [], points
    for n in range(order):
        if n:
            packed = (packed[:-1] << 21) | points[n:]
        grams.append(packed if n else packed.copy())
    found = np.sort(np.concatenate([np.sort(g) for g in grams]))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


@dataclass(frozen=True)
class Model:
    """Languages, the n-grams of the landmarks (sorted), which landmarks have them, and weights."""

    languages: list[str]
    grams: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    order: int = 3
    sharpness: float = 6.0

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        out = np.zeros((len(texts), len(self.norms)), np.float64)
        for i, text in enumerate(texts):
            own = gram_set(text, self.order)
            at = np.searchsorted(self.grams, own)
            at[at == len(self.grams)] = 0
            hit = at[self.grams[at] == own]
            out[i] = self.presence[hit].sum(0, dtype=np.float32) / (np.sqrt(len(own)) * self.norms)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Shares between 0 and 1 for each language, from one matrix product."""
        values = self.kernel(texts) @ self.weights
        values = np.exp(self.sharpness * (values - values.max(1, keepdims=True)))
        return values / values.sum(1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _landmarks(rows: DataFrame, count: int, chars: int) -> list[tuple[str, str]]:
    """Whole texts spread over the languages, chosen by hash: the same number of each, at least one.

    Texts are of ``chars`` characters at most; a language that has only longer ones gives its shortest.
    """
    sized = rows.where(F.length("text") > 0)
    limits = sized.groupBy("lang").agg(F.greatest(F.lit(chars), F.min(F.length("text"))).alias("limit"))
    each = max(1, count // max(1, limits.count()))
    fit = sized.join(F.broadcast(limits), "lang").where(F.length("text") <= F.col("limit")).drop("limit")
    # those of 40 characters or more first: a short text spans little
    ids = fit.select("lang", F.xxhash64("text").alias("h"), (F.length("text") < 40).alias("short")).distinct()
    # first by a share of the hash range within each language, so that no task ranks a whole language
    block = F.pmod("h", F.lit(1024))
    inside = Window.partitionBy("lang", "block").orderBy("short", "h")
    first = ids.withColumn("block", block).withColumn("r", F.row_number().over(inside)).where(F.col("r") <= each)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("short", "block", "h")))
    chosen = ranked.where(F.col("r") <= each).select("lang", "h")
    texts = fit.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    return sorted((r.lang, r.text) for r in texts.select("lang", "text").collect())


def fit(
    rows: DataFrame, *, landmarks: int = 240, landmark_chars: int = 8_000, training_rows: int = 20_000,
    ridge: float = 1e-2, order: int = 3,
) -> Model | None:
    """Learn from ``text`` and non-null ``lang``; None without any.

    About ``training_rows`` rows, the same number of each language and chosen by the
    hash of the text, give the sums that the regressions need; a language with fewer
    gives all it has, and languages weigh the same however many rows they have.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    base = _landmarks(rows, landmarks, landmark_chars)
    if not base:
        return None
    languages = sorted({lang for lang, _ in base})
    sets = [gram_set(text, order) for _, text in base]
    grams = np.unique(np.concatenate(sets))
    presence = np.zeros((len(grams), len(sets)), np.uint8)
    for j, s in enumerate(sets):
        presence[np.searchsorted(grams, s), j] = 1
    norms = np.sqrt(np.array([len(s) for s in sets], np.float64))
    bare = Model(languages, grams, presence, norms, np.zeros((len(sets), len(languages))), order)
    own = presence.astype(np.float32).T @ presence.astype(np.float32) / np.outer(norms, norms)
    value, vector = np.linalg.eigh(own.astype(np.float64))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])

    # one row a language
    share = rows.groupBy("lang").agg((F.lit(training_rows / len(languages)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    known = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("text", "lang")
    size, context = int(keep.sum()), rows.sparkSession.sparkContext
    shared = context.broadcast((bare, whiten))

    def start():
        model, white = shared.value
        index = {lang: i for i, lang in enumerate(model.languages)}

        def work(columns):
            langs, texts = columns
            pick = [i for i, t in enumerate(texts) if has_letter(t)]
            if not pick:
                return [[], [], [], []]
            x = model.kernel([texts[i] for i in pick]) @ white
            of = np.array([index[langs[i]] for i in pick])
            out = [[], [], [], []]
            for k in np.unique(of):
                mine = x[of == k]
                out[0].append(int(k))
                out[1].append(len(mine))
                out[2].append((mine.T @ mine).ravel())
                out[3].append(mine.sum(0))
            return out
        return work

    sums = map_texts(known, ["lang", "text"], "k int, n long, square array<double>, total array<double>", start,
                     chars=1 << 22)
    # sums of one batch and language each; added up on the executors, a few reach the driver
    added = sums.groupBy("k", (F.abs(F.xxhash64("total")) % 8).alias("part")).applyInArrow(
        _add_up, "k int, n long, square array<double>, total array<double>")
    gram, moment, weight = np.zeros((size, size)), np.zeros((size, len(languages))), np.zeros(len(languages))
    square, total_of = {}, {}
    for r in added.toLocalIterator():
        square[r.k] = square.get(r.k, 0) + np.array(r.square).reshape(size, size)
        total_of[r.k] = total_of.get(r.k, 0) + np.array(r.total)
        weight[r.k] += r.n
    for k in square:
        gram += square[k] / weight[k]
        for c in range(len(languages)):
            moment[:, c] += (1.0 if c == k else -1.0) * total_of[k] / weight[k]
    solved = np.linalg.solve(gram + ridge * np.eye(size), moment)
    return Model(languages, grams, presence, norms, whiten @ solved, order)


def _add_up(table: pa.Table) -> pa.Table:
    add = lambda name: np.add.reduce([np.asarray(x.values) for x in table[name]])
    return pa.table({
        "k": pa.array([table["k"][0].as_py()], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()),
        "square": pa.array([add("square")], pa.list_(pa.float64())), "total": pa.array([add("total")], pa.list_(pa.float64()))})


def predict(docs: DataFrame, model: Model | None, keys: list[str], *, text: str = "text") -> DataFrame:
    """``keys``, ``lang_pred`` and ``score`` of every row."""
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def work(columns):
            texts = columns[-1]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            pick = [i for i, t in enumerate(texts) if has_letter(t)] if own else []
            if pick:
                found = own.scores([texts[i] for i in pick])
                for i, k, s in zip(pick, found.argmax(1), found.max(1)):
                    names[i], scores[i] = own.languages[k], float(s)
            return [*columns[:-1], names, scores]
        return work

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", lang_pred string, score double"
    return map_texts(docs, [*keys, text], schema, start)


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of an id as text, by remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
