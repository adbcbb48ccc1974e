"""Text quality by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A
text that compresses to less with the good one looks like good text; the
difference of both compressed sizes, normalised by their sum, is turned into a
probability by logistic calibration on labelled rows that the dictionaries have
not seen.

The model is bounded by its parameters: about ``rows`` labelled texts
(:func:`bounded`), of them at most ``samples`` whole texts of each kind, up to
``sample_chars`` characters long, for dictionaries of ``dictionary_bytes``, and
half for the two numbers of the calibration.

Defined results: null and empty texts are scored from a difference of zero, as
are all texts if one of the labels is missing; rows that repeat get equal
results; an empty table gives an empty result. If a document has several labels,
each counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts
from kinetable.settings import checkpointed

BLOCK = 1 << 12


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int = 6
    slope: float = 1.0
    offset: float = 0.0

    def compressors(self):
        return [zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, dict_data=(
            zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for d in (self.good, self.bad)]


def difference(text: str | None, good, bad) -> float:
    """(bad - good) / (bad + good) of the compressed sizes; over 0 if the text is nearer to the good one.

    A text is compressed in blocks of 4 KiB, each against the dictionary alone,
    so that a long one does not come to be its own dictionary. All blocks count.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    g = b = 0
    for begin in range(0, len(data), BLOCK):
        part = data[begin:begin + BLOCK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if b + g else 0.0


def dictionary(texts: list[str], size: int) -> bytes:
    """Raw content dictionary: whole texts, one after the other, as many as fit."""
    out = b""
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") + b"\n"
        if len(out) + len(data) <= size:
            out = data + out
    return out


def bounded(labels: DataFrame, key: str, rows: int = 30_000) -> DataFrame:
    """About ``rows`` of the rows, chosen by the hash of their key; all if there are no more."""
    count = labels.count()
    if count <= rows:
        return labels
    return labels.where(F.pmod(F.xxhash64(key, F.lit("label")), F.lit(1 << 31)) < int(rows / count * (1 << 31)))


def fit(
    rows: DataFrame, *, samples: int = 1_000, sample_chars: int = 4_000, dictionary_bytes: int = 400_000, level: int = 6,
) -> Model | None:
    """Learn from ``text`` and ``quality`` (0 or 1) of a bounded table; None if one of them has no text.

    Rows are dealt by the hash of their text: half to the dictionaries, half to
    the calibration.
    """
    rows = checkpointed(rows.where(F.col("quality").isin(0, 1) & F.col("text").isNotNull()).select(
        "text", F.col("quality").cast("int").alias("quality"), F.xxhash64("text", F.lit("deal")).alias("deal")))
    half = F.pmod("deal", F.lit(2)) == 0
    texts = {}
    for label in (0, 1):
        # as many as wanted in the order of their hashes; only the hashes are sorted
        fit_for = rows.where(half & (F.col("quality") == label) & F.length("text").between(1, sample_chars))
        last = [r.deal for r in fit_for.select("deal").distinct().orderBy("deal").limit(samples).collect()][-1:]
        found = fit_for.where(F.col("deal") <= last[0]).dropDuplicates(["deal"]).orderBy("deal").select("text").collect() if last else []
        texts[label] = [r.text for r in found]
    if not texts[0] or not texts[1]:
        return None
    model = Model(dictionary(texts[1], dictionary_bytes), dictionary(texts[0], dictionary_bytes), level)
    values = differences(rows.where(~half), model, ["quality"]).toPandas()
    if values["quality"].nunique() == 2:
        slope, offset = logistic(values["difference"].to_numpy(), values["quality"].to_numpy())
        model = Model(model.good, model.bad, level, slope, offset)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, by Newton's method."""
    scale = x.std() or 1.0
    rows = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2), rows.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def differences(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        good, bad = shared.value.compressors()
        return lambda columns: [*columns[:-1], [difference(t, good, bad) for t in columns[-1]]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", difference double"
    return map_texts(docs, [*keys, text], schema, start)


def scored(docs: DataFrame, model: Model | None, keys: list[str], *, text: str = "text") -> DataFrame:
    """``keys`` and ``score`` (0 to 1) of every row; 0.5 without a model."""
    if model is None:
        return docs.select(*keys, F.lit(0.5).alias("score"))
    found = differences(docs, model, keys, text)
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("difference") + F.lit(model.offset))))
    return found.select(*keys, score.alias("score"))
