"""Licence statements in texts, by conditional compression.

A candidate block is a line with a word that licence statements use. It is
compressed alone and once with each template as raw zstandard dictionary; the
template that saves the largest share of the block's size explains it best. The
best few are confirmed by their exact wording: the words of the template that
the block lacks, and those it adds in between. Fewest differences win, so
versions that share most of their wording are told apart.

Defined results: null and empty texts have no block; one row for each candidate
block, with a null licence if no template is confirmed; rows that repeat are
reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts

# fixed values: short statements by which texts are put under a licence
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}
CUES = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|\bCC[ -](BY|0)|\bCC0"
_WORDS = re.compile(r"\w+(?:[.-]\w+)*")


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


def differences(block: list[str], template: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words the block has between those that match."""
    lacking, added = [], []
    parts = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    matched = [i for i, p in enumerate(parts) if p[0] == "equal"]
    for i, (kind, a, b, c, d) in enumerate(parts):
        if kind != "equal":
            lacking += template[a:b]
            if matched and matched[0] < i < matched[-1]:
                added += block[c:d]
    return lacking, added


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3, confirm: int = 3, tolerated: float = 0.2):
        bare = lambda **extra: zstandard.ZstdCompressor(
            level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **extra)
        self.alone = bare()
        self.names = sorted(templates)
        self.words = {n: wording(templates[n]) for n in self.names}
        self.given = {n: bare(dict_data=zstandard.ZstdCompressionDict(
            templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n in self.names}
        self.confirm, self.tolerated = confirm, tolerated

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save, the most first."""
        data = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        return sorted(((1 - len(z.compress(data)) / size, n) for n, z in self.given.items()), key=lambda x: (-x[0], x[1]))

    def winner(self, block: str) -> tuple[str | None, float, list[str], list[str]]:
        """Licence, saved share, lacking and added words; no licence if too much of the wording differs."""
        best = self.ranked(block)[:self.confirm]
        words = wording(block)
        judged = [(saved, name, *differences(words, self.words[name])) for saved, name in best]
        saved, name, lacking, added = min(judged, key=lambda j: (len(j[2]) + len(j[3]), -j[0], j[1]))
        confirmed = len(lacking) + len(added) <= self.tolerated * len(self.words[name])
        return (name if confirmed else None), saved, lacking, added


def scan(
    docs: DataFrame, keys: list[str], *, text: str = "text", templates: dict[str, str] = TEMPLATES, cues: str = CUES,
) -> DataFrame:
    """One row for each candidate block: ``keys``, ``line`` (from 0), ``block``, ``license``, ``saved``, ``lacking``, ``added``."""
    lines = docs.select(*[F.col(f"`{k}`").alias(f"__key_{k}") for k in keys], F.posexplode(
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("line", "block"))
    blocks = lines.where(F.col("block").rlike(cues))
    kinds = dict(blocks.dtypes)
    names = [f"__key_{k}" for k in keys]

    def start():
        scanner, memo = Scanner(templates), {}

        def work(columns):
            found = []
            for block in columns[-1]:
                if block not in memo:
                    if len(memo) > 10_000:
                        memo.clear()
                    memo[block] = scanner.winner(block)
                found.append(memo[block])
            return [*columns, *[list(c) for c in zip(*found)]] if found else [*columns, [], [], [], []]
        return work

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + (
        ", line int, block string, license string, saved double, lacking array<string>, added array<string>")
    out = map_texts(blocks, [*names, "line", "block"], schema, start)
    return out.select(*[F.col(f"__key_{k}").alias(k) for k in keys],
                      "line", "block", "license", "saved", "lacking", "added")
