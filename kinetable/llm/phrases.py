"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, these into phrases of phrases, and so on. At each
level runs of one name become one name, deterministic coin tossing (three times:
the place and value of the lowest bit in which a name differs from the one
before it) brings names down to six labels of which neighbours differ, and a new
phrase starts at every local maximum. A phrase is named by a hash of what it
holds. Where phrases start depends on a few names around, so equal substrings
have the same phrases inside, whatever their offset.

The fingerprint holds the ``keep`` least names of levels ``lowest`` and up; two
fingerprints give an estimate of the share of phrases that two texts have in
common (exact if both have at most ``keep``).

Defined results: null is an empty text, whose fingerprint is empty and like
other empty ones only; rows go by id, those with equal ids by the hash of their
text, null ids last; the only row is its own next one; an empty table gives an
empty result; columns not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import small_batches

_LAST_ID = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_LOWEST = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _coin(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels: twice the lowest bit in which a name differs from the one before, plus that bit."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ names.dtype.type(1)
    x = names ^ before
    if names.dtype == np.uint8:
        place = _LOWEST[x]
        return (place << np.uint8(1)) | ((names >> place) & np.uint8(1))
    place = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    return (place << np.uint8(1)) | ((names >> place.astype(np.uint64)).astype(np.uint8) & np.uint8(1))


def _phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level; ``starts`` are the first places of the (non-empty) texts."""
    n = len(names)
    new = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[starts] = True
    heads = np.flatnonzero(new)
    if len(heads) < n:
        length = np.diff(np.append(heads, n)).astype(np.uint64)
        names = names[heads]
        names = np.where(length > 1, _mix(names + _A * length), names)
        starts = np.searchsorted(heads, starts)
        n = len(names)
    # equal neighbours can only be left across texts; a text's first name is compared with nothing
    label = _coin(_coin(_coin(names, starts), starts), starts)
    begin = np.zeros(n, bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(starts[1:], n) - 1
    begin[last] = False
    begin[starts[starts + 1 < n] + 1] = False  # a phrase has two names or more
    begin[starts] = True
    heads = np.flatnonzero(begin)
    offset = np.arange(n, dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, n))).astype(np.uint64)
    total = np.add.reduceat(_mix(names + _A * (offset + np.uint64(1))), heads)
    return _mix(total), np.searchsorted(heads, starts)


def sketches(texts: list[str], *, keep: int = 64, lowest: int = 2) -> list[np.ndarray]:
    """The least names of each text, sorted, as 32-bit numbers; a text has a name on each level."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(lengths)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(full):
        return out
    with np.errstate(over="ignore"):
        names, starts = _mix(points + _A), np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
        owner = full
        level, found = 0, []
        while len(owner):
            size = np.diff(np.append(starts, len(names)))
            if level >= lowest:
                found.append((np.repeat(owner, size), (_mix(names + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)))
            # texts with one name left are done, from the lowest level on
            going = size > 1 if level >= lowest else np.ones(len(owner), bool)
            if not going.all():
                names = names[np.repeat(going, size)]
                owner, size = owner[going], size[going]
                starts = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
            if len(owner):
                names, starts = _phrases(names, starts)
            level += 1
    owner = np.concatenate([o for o, _ in found]).astype(np.uint64)
    keyed = np.sort(owner << np.uint64(32) | np.concatenate([v for _, v in found]))
    keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
    edges = np.searchsorted(keyed, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    least = keyed.astype(np.uint32)
    return [least[a:min(b, a + keep)] for a, b in zip(edges, edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = 64) -> float:
    """Estimated share of common phrases (twice the common ones by all of both), 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) >= keep or len(b) >= keep:
        union = union[:keep]
    both = np.intersect1d(a, b, assume_unique=True)
    common = np.searchsorted(both, union[-1], side="right") / len(union)
    return float(2 * common / (1 + common))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of a text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, *, order: str, text: str = "text", pieces: int | None = None) -> DataFrame:
    """Rows sorted within ranges of the order, each range followed by the first row of the next one.

    Gives ``range``, ``guest`` (true for the row that follows), ``id``, ``tie``,
    ``null_id`` and ``text``, sorted within partitions. The ranges come from
    approximate quantiles: a few numbers for each partition reach the driver.
    """
    spark = docs.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(f"`{order}`").cast("long"), F.lit(_LAST_ID)).alias("id"),
        F.col(f"`{order}`").isNull().alias("null_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = rows.agg(F.percentile_approx("id", [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = rows.withColumn("range", _range(F.col("id"), cuts))
    heads = ranged.groupBy("range").agg(F.min(F.struct("id", "null_id", "tie")).alias("head"))
    along = Window.orderBy(F.desc("range"))  # one row for each range
    heads = heads.withColumn("before", F.lead("range").over(along)).withColumn(
        "before", F.coalesce("before", F.max("range").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = heads.select(F.col("head.id").alias("id"), F.col("head.tie").alias("tie"), "before")
    guests = rows.join(F.broadcast(heads), ["id", "tie"]).dropDuplicates(["before"])
    both = ranged.select("range", F.lit(False).alias("guest"), "id", "null_id", "tie", "text").unionByName(
        guests.select(F.col("before").alias("range"), F.lit(True).alias("guest"), "id", "null_id", "tie", "text"))
    return both.repartition("range").sortWithinPartitions("range", "guest", "id", "null_id", "tie")


def _range(value: Column, cuts: list[int]) -> Column:
    """Number of cuts up to a value, by halving."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), between(low, middle)).otherwise(between(middle + 1, high))
    return between(0, len(cuts))


_RESULT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def fingerprints_with_next(
    docs: DataFrame, *, order: str, text: str = "text", keep: int = 64, lowest: int = 2, pieces: int | None = None,
) -> DataFrame:
    """Fingerprints of every text and of its edited form (see :func:`edited`), and how alike they are."""
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for rows in _groups(batches):
            held += rows
            if sum(len(r[4]) for r in held) > 1 << 17:
                yield finish(held)
                held = held[-1:]
        if held:
            yield finish(held)

    def finish(rows):
        """Results of all rows but the last one, which only follows, and guests."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        changed = [edited(rows[i][4], rows[i + 1][4]) for i in own]
        made = sketches([r[4] for r in rows] + changed, keep=keep, lowest=lowest)
        out = []
        for k, (i, new) in enumerate(zip(own, changed)):
            mine, its, following = made[i], made[len(rows) + k], made[i + 1]
            out.append((
                None if rows[i][3] else rows[i][2], len(rows[i][4]),
                hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(mine), as_text(its), likeness(mine, its, keep), likeness(mine, following, keep)))
        columns = list(zip(*out)) or [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def _groups(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [(*r[:-1], r[-1] or "") for r in zip(*columns)]
            for begin in range(0, len(rows), 64):
                yield rows[begin:begin + 64]

    ready = with_next(small_batches(docs), order=order, text=text, pieces=pieces)
    return ready.select("range", "guest", "id", "null_id", "text").mapInArrow(run, _RESULT)
