"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into ``blocks`` parts. Two that differ in at most ``bits``
bits leave at least ``blocks - bits`` parts equal, so they meet under the key of
some choice of that many parts; every meeting is verified by Hamming distance,
and a pair counts only under its first common key. With the default of seven
parts a key holds 27 bits or more: chance meetings stay rare up to some
100 million different fingerprints; take more blocks beyond.

Equal fingerprints are one node from the start, so copies form no pairs. Keys
that more than ``crowd`` different fingerprints share are not paired up. Their
fingerprints are linked exactly through points between them instead: two differ
in at most ``bits`` bits if and only if some value is within half as many of
both, so each is listed under all values that near, and hung on the smallest
fingerprint listed there. That is linear, whatever the size of the crowd.

Defined results: a text without words (null, empty) has the fingerprint zero and
is linked like any other; rows that repeat join one component; a component whose
ids are all null has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import WORD, map_texts
from kinetable.llm.components import components
from kinetable.settings import checkpointed

_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())
_WORDS = re.compile(WORD)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` lower-cased words; one of all words if there are fewer."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWERED))
    if len(found) < size:
        return [b" ".join(found)] if found else []
    return [b" ".join(found[i:i + size]) for i in range(len(found) - size + 1)]


def majority(hashes: bytes) -> int:
    """Bits set in over half of the 8-byte hashes, as a signed number."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for begin in range(0, len(rows), 1 << 16):
        total += np.unpackbits(rows[begin:begin + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keys: list[str], *, text: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """``keys`` and ``fingerprint`` (a long) of every row."""
    kinds = dict(docs.dtypes)

    def start():
        digest = xxhash.xxh64_digest

        def work(columns):
            return [*columns[:-1], [
                majority(b"".join([digest(s, seed) for s in found])) if (found := shingles(t, size)) else 0
                for t in columns[-1]]]
        return work

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", fingerprint long"
    return map_texts(docs, [*keys, text], schema, start)


def _parts(blocks: int) -> list[int]:
    """Masks of consecutive parts of 64 bits, the wider ones first."""
    width, rest = divmod(64, blocks)
    edges = list(itertools.accumulate([0] + [width + (i < rest) for i in range(blocks)]))
    return [_signed((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, *, bits: int = 4, blocks: int = 7, crowd: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect all of ``fingerprint`` (distinct) with ``bits`` or fewer differing bits.

    Pairs under crowded keys are connected through their common smallest
    neighbour, so an edge may stand for up to ``bits`` bits on either side of it.
    """
    if blocks <= bits:
        raise ValueError("pairs are only sure to share a block if there are more blocks than bits")
    parts = _parts(blocks)
    choices = list(itertools.combinations(range(blocks), blocks - bits))
    masks = [_signed(reduce(lambda x, i: x | (parts[i] & (2**64 - 1)), c, 0)) for c in choices]
    # the parts before a choice's last that it leaves out: all of them differ if it is the first choice of a pair
    left_out = [[parts[i] for i in range(c[-1]) if i not in c] for c in choices]

    keyed = prints.select("fingerprint", F.posexplode(F.lit(masks)).alias("choice", "mask")).select(
        "choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint")
    met = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the keys for as small as the fingerprints they come from, and would broadcast them all
    shared = checkpointed(keyed.join(met.hint("merge"), ["choice", "key"]))

    few = shared.where(F.col("n") <= crowd)
    one = few.select("choice", "key", F.col("fingerprint").alias("a"))
    two = few.select("choice", "key", F.col("fingerprint").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.forall(F.get(F.lit(left_out), F.col("choice")), lambda m: differ.bitwiseAND(m) != 0)
    pairs = one.join(two, ["choice", "key"]).where(
        (F.col("a") > F.col("b")) & (F.bit_count(differ) <= bits) & first).select("a", "b")

    crowded = shared.where(F.col("n") > crowd).select("fingerprint").distinct()
    return pairs.unionByName(_through_midpoints(crowded, bits))


def _through_midpoints(prints: DataFrame, bits: int) -> DataFrame:
    from pyspark.sql import Window

    half = bits // 2
    if bits % 2:
        raise ValueError("midpoints need an even number of bits")
    flips = [_signed(reduce(lambda x, i: x | 1 << i, c, 0)) for r in range(half + 1)
             for c in itertools.combinations(range(64), r)]
    listed = prints.select("fingerprint", F.explode(F.lit(flips)).alias("flip")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"))
    low = F.min("fingerprint").over(Window.partitionBy("point"))
    return listed.select(F.col("fingerprint").alias("a"), low.alias("b")).where("a != b").distinct()


def near_duplicates(
    docs: DataFrame, keys: list[str], *, order: str, text: str = "text", size: int = 4, seed: int = 42,
    bits: int = 4, blocks: int = 7, crowd: int = 64,
) -> DataFrame:
    """``keys``, ``fingerprint`` and ``component``: the smallest ``order`` column value of all reachable rows."""
    prints = checkpointed(fingerprints(docs, keys, text=text, size=size, seed=seed))
    nodes = prints.groupBy("fingerprint").agg(F.min(order).alias("low"))
    roots = components(links(nodes.select("fingerprint"), bits=bits, blocks=blocks, crowd=crowd), "a", "b")
    placed = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    of_print = placed.join(lows, "root").select("fingerprint", "component")
    return prints.join(of_print, "fingerprint").select(*keys, "fingerprint", "component")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
