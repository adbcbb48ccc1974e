"""Encode texts into pieces of a SentencePiece vocabulary, and decode them.

A text is a lattice: its places are nodes, each piece found in it an edge. The
best path is found by a forward Viterbi pass; its scores at each node are exact
for what is left to a search that walks back from the end, so an A-star search
yields the N best segmentations one after the other without a wasted step.

The lattice falls into independent blocks where no piece of the vocabulary spans
the border: before blanks, after words that signs follow, around line ends. A batch is taken apart into its different
words; the blocks of those that are not known of late are one lattice of many lines, and the N best of a text follow
from those of its blocks. A score is the sum over pieces; a vocabulary with
merge ranks in place of log probabilities is read as Zipf's law (minus the
logarithm of the rank). Characters outside the vocabulary become byte pieces.

Defined results: null and empty texts have no pieces and decode to an empty
text; other texts decode to themselves exactly; rows that repeat get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from kinetable.llm.common import map_texts, utf8

BLANK = "▁"
MEMO = 60_000
_WORDS = re.compile(" ( *[^ ]*)")
_NONE = array("f", [math.inf]).tobytes()


class Vocabulary:
    """Pieces, their scores, and the pairs of characters that occur inside of pieces."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes, self.ids, scores = {}, {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], scores[piece] = i, model.get_score(i)
        ranks = all(float(s).is_integer() for s in scores.values())
        score = {p: -math.log(2 - s) if ranks else s for p, s in scores.items()}
        self.byte_score = min(score.values()) - 10
        # a tree of characters: what may follow, and (score, id) if a piece ends here
        self.tree: dict[str, tuple] = {}
        for piece, i in sorted(self.ids.items()):
            node = self.tree
            for char in piece[:-1]:
                node = node.setdefault(char, ({}, None))[0]
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], (score[piece], (i,)))
        self.score_of_id = np.full(len(self.pieces), self.byte_score)
        for piece, i in self.ids.items():
            self.score_of_id[i] = score[piece]
        self._number_states()
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.chars = {p for p in self.ids if len(p) == 1}
        # characters that stand in no longer piece are blocks of their own; a block also ends
        # before signs that no piece has right after a letter or digit
        paired = {c for pair in self.inside for c in pair}
        after = {b for a, b in self.inside if a.isalnum()}
        alone = "".join(sorted(set("\n\t\r") - paired))
        signs = "".join(re.escape(c) for c in sorted((set("".join(self.ids)) - after) | set(alone))
                        if not (c.isalnum() or c in BLANK + "_"))
        rest = f"[^{BLANK}{re.escape(alone)}]"
        self.blocks = re.compile(
            (f"[{re.escape(alone)}]|" if alone else "") + f"{BLANK}*(?:\\w++(?:(?=[{signs}])|{rest}*)|{rest}+)|{BLANK}+")

        self.of_id = {i: b for b, i in self.bytes.items()}
        self.plain = [None if i in self.of_id else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]
        self.raw = pa.array([bytes([self.of_id[i]]) if p is None else utf8(p) for i, p in enumerate(self.plain)], pa.binary())
        self.spelled = np.zeros(0x110000, bool)
        self.spelled[[ord(c) for c in self.chars]] = True

    def _number_states(self) -> None:
        """The tree once more, for whole arrays: an open hash table from state and character to state."""
        own, piece_of, todo = [], [-1], [(0, self.tree)]
        while todo:
            state, node = todo.pop()
            for char, (below, edge) in node.items():
                own.append(state << 21 | ord(char))
                todo.append((len(piece_of), below))
                piece_of.append(edge[1][0] if edge else -1)
        # a quarter full at most, and no larger than it must be: it is to stay in the processor's cache
        self.bits = max(10, (4 * len(own)).bit_length())
        self.slots = 1 << self.bits
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        for value, key in enumerate(own, 1):
            slot = (key * _FACTOR & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[slot] != -1:
                slot = (slot + 1) % self.slots
            self.keys[slot], self.values[slot] = key, value
        self.piece_of = np.array(piece_of, np.int32)
        # states after the first character; the beginning, where no piece ends, for characters without a piece
        self.first = np.zeros(0x110000, np.int32)
        for value, key in enumerate(own, 1):
            if key >> 21 == 0:
                self.first[key] = value

    def step(self, state: np.ndarray, points: np.ndarray) -> np.ndarray:
        """States after one more character each; -1 where no piece goes on."""
        key = state.astype(np.int64) << 21 | points
        slot = ((key.view(np.uint64) * np.uint64(_FACTOR)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            slot[open_] = (slot[open_] + 1) % self.slots
        return out


_FACTOR = 0x9E3779B97F4A7C15


def solve_all(points: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of many blocks at once: ids one block after the other, how many each has, and what the next
    best of each loses.

    ``points`` are the characters of all blocks, ``sizes`` how many each has.
    All blocks are one lattice of many lines. Forward, node by node along them,
    the best scores; then each line is walked back from its end. The frontier
    that A-star has when it reaches the beginning are the edges that the best
    path passed by, each with the score behind it plus the exact score before
    it, so the greatest of them is the score of the next best segmentation.
    All characters must be in the vocabulary.
    """
    v = vocabulary
    sizes = sizes.astype(np.int32)
    # a line has a node more than characters
    ends = np.cumsum(sizes + 1, dtype=np.int32) - 1
    first = ends - sizes
    lines = np.arange(len(sizes), dtype=np.int32)
    line = np.repeat(lines, sizes)
    node_of = np.arange(len(points), dtype=np.int32) + line
    left = np.repeat(ends, sizes) - node_of
    at, state, found = np.arange(len(points), dtype=np.int32), v.first[points], []
    depth = 1
    while len(at):
        piece = v.piece_of[state]
        whole = np.flatnonzero(piece >= 0)
        found.append((node_of[at[whole]], np.full(len(whole), depth, np.int32), piece[whole]))
        going = np.flatnonzero(left[at] > depth)
        at = at[going]
        state = v.step(state[going], points[at + depth])
        depth += 1
        going = np.flatnonzero(state >= 0)
        at, state = at[going], state[going]
    source, width, piece = (np.concatenate(x) for x in zip(*found))
    target = source + width
    line_of = np.repeat(lines, sizes + 1)
    along = (target - first[line_of[source]]).astype(np.uint16)
    order = np.argsort(along, kind="stable")
    source, target, piece = source[order], target[order], piece[order]
    score = v.score_of_id[piece]

    best = np.full(len(points) + len(sizes), -np.inf)
    chosen = np.zeros(len(best), np.int32)
    best[first] = 0.0
    steps = np.concatenate(([0], np.cumsum(np.bincount(along)))).tolist()
    for low, high in zip(steps[1:], steps[2:]):
        value, node = best[source[low:high]] + score[low:high], target[low:high]
        np.maximum.at(best, node, value)
        top = np.flatnonzero(value == best[node])
        chosen[node[top]] = low + top

    behind = np.full(len(best), np.nan)
    behind[ends] = 0.0
    node, on, walked = ends, lines, []
    while len(node):
        edge = chosen[node]
        walked.append((on, piece[edge]))
        behind[source[edge]] = behind[node] + score[edge]
        node = source[edge]
        going = np.flatnonzero(node != first[on])
        node, on = node[going], on[going]
    passed = ~np.isnan(behind)[target]
    passed[chosen[ends]] = False
    passed = np.flatnonzero(passed)
    passed = passed[chosen[target[passed]] != passed]
    next_best = np.full(len(sizes), -np.inf)
    np.maximum.at(next_best, line_of[source[passed]], behind[target[passed]] + score[passed] + best[source[passed]])
    loss = (best[ends] - next_best).astype(np.float32)

    on = np.concatenate([x for x, _ in walked[::-1]])
    ids = np.concatenate([x for _, x in walked[::-1]])[np.argsort(on, kind="stable")]
    return ids, np.bincount(on), loss


def _parted(ids: np.ndarray, counts: np.ndarray, loss: np.ndarray) -> list[bytes]:
    """Solved parts as bytes: what the next best loses, and the ids."""
    cuts = np.concatenate(([0], np.cumsum(counts + 1)))
    words, body = np.empty(cuts[-1], np.int32), np.ones(cuts[-1], bool)
    body[cuts[:-1]] = False
    words[cuts[:-1]], words[body] = loss.view(np.int32), ids
    raw, cuts = words.tobytes(), (4 * cuts).tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


class Lattice:
    """Edges by end node, and the best score up to each node; nodes are places in the text."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        n = len(text)
        self.ending: list[list[tuple]] = [[] for _ in range(n + 1)]
        self.best = best = [-math.inf] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, node = best[i], vocabulary.tree
            for j in range(i, n):
                found = node.get(text[j])
                if found is None:
                    break
                node, edge = found
                if edge:
                    score = here + edge[0]
                    self.ending[j + 1].append((i, *edge))
                    if score > best[j + 1]:
                        best[j + 1] = score
            if text[i] not in vocabulary.ids:
                raw = text[i].encode("utf-8", "surrogatepass")
                score = vocabulary.byte_score * len(raw)
                self.ending[i + 1].append((i, score, tuple(vocabulary.bytes[b] for b in raw)))
                best[i + 1] = max(best[i + 1], here + score)

    def paths(self, count: int) -> list[tuple[float, list[int]]]:
        """The best segmentations, best first, by A-star from the end: what is left to a
        node costs exactly its forward score. Of equal ones, that nearest to the beginning goes
        on first (scores are rounded for this), so that many equal paths are not all followed."""
        best, ending, push, pop = self.best, self.ending, heapq.heappush, heapq.heappop
        out, heap, reached = [], [(round(-best[-1], 6), len(best) - 1, 0, 0.0, None)], 0
        while heap and len(out) < count:
            _, node, _, done, tail = pop(heap)
            if node == 0:
                ids = []
                while tail:
                    own, tail = tail
                    ids += own
                out.append((done, ids))
                continue
            for begin, score, ids in ending[node]:
                reached += 1
                push(heap, (round(-(done + score + best[begin]), 6), begin, reached, done + score, (ids, tail)))
        return out


def _joined(parts: list[bytes]) -> bytes:
    """Parts side by side as one: the next best changes the one that loses least."""
    return array("f", [min([array("f", p[:4])[0] for p in parts])]).tobytes() + b"".join([p[4:] for p in parts])


class Encoder:
    """Solves blocks and joins them; keeps what it solved, up to a bound.

    A solved block is four bytes with what the next best segmentation loses (a
    float), and the ids of the best one (four bytes each).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # words (a blank goes before each) and other blocks that were solved of late, and before
        # that; the older half goes when the newer one is full
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        # the best segmentations of parts that a next best text changes
        self.options: dict[tuple, list] = {}
        # a blank sign that is in the text itself
        self.literal = _NONE + array("i", [vocabulary.bytes[b] for b in BLANK.encode()]).tobytes()

    def _spelled(self, block: str) -> bytes:
        """One block by itself, byte pieces included."""
        (score, ids), *others = Lattice(block, self.vocabulary).paths(2)
        return array("f", [score - others[0][0] if others else math.inf]).tobytes() + array("i", ids).tobytes()

    def solve(self, wanted: list[str]) -> dict[str, bytes]:
        """Parts of different blocks; all that are not known are solved together."""
        memo, older, inside = self.memo.get, self.older[1].get, self.vocabulary.chars.issuperset
        known = {b: part for b in wanted if (part := memo(b) or older(b)) is not None}
        unknown = [b for b in wanted if b not in known]
        plain = [b for b in unknown if len(b) <= 256 and inside(b)]
        if plain:
            points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
            known.update(zip(plain, _parted(*solve_all(points, np.array([len(b) for b in plain]), self.vocabulary))))
        for block in unknown:
            if block not in known:
                known[block] = self._spelled(block)
        if len(self.memo) + len(known) > MEMO:
            self.older, self.memo = (self.older[0], self.memo), {}
        self.memo.update((b, part) for b, part in known.items() if len(b) <= 64)
        return known

    def solve_words(self, wanted: list[str]) -> list[bytes]:
        """Parts of different words, each with the blank before it (blanks that a word begins with are more of these);
        all that are not known are solved together."""
        found = list(map(self.words.get, wanted))
        fresh = [k for k, part in enumerate(found) if part is None]
        older, unknown = self.older[0].get, []
        for k in fresh:
            part = found[k] = older(wanted[k])
            if part is None:
                unknown.append(k)
        if unknown:
            for k, part in zip(unknown, self._solved([wanted[k] for k in unknown])):
                found[k] = part
        if len(self.words) + len(fresh) > MEMO:
            self.older, self.words = (self.words, self.older[1]), {}
        self.words.update([(w, found[k]) for k in fresh if len(w := wanted[k]) <= 64])
        return found

    def _solved(self, words: list[str]) -> list[bytes]:
        """The same for unknown ones: their blocks are lines of one lattice. Those that are blank, very long or have
        characters outside the vocabulary go by themselves."""
        sizes = np.array([*map(len, words)]) + 1
        text = (BLANK + BLANK.join(words)).replace(" ", BLANK)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        whole = np.logical_and.reduceat(self.vocabulary.spelled[points], ends - sizes) & (points[ends - 1] != ord(BLANK)) & (sizes <= 256)
        out, split, rest = [], self.vocabulary.blocks.findall, {}
        if not whole.all():
            points, sizes = points[np.repeat(whole, sizes)], sizes[whole]
            text = points.tobytes().decode("utf-32-le")
            rest = {k: split(BLANK + words[k].replace(" ", BLANK)) for k in np.flatnonzero(~whole).tolist()}
        if text:
            widths = np.array([*map(len, split(text))])
            ids, counts, loss = solve_all(points, widths, self.vocabulary)
            # blocks end where words do, as the next word's blank begins another
            begins = np.searchsorted(np.cumsum(widths) - widths, np.cumsum(sizes) - sizes)
            out = _parted(ids, np.add.reduceat(counts, begins), np.minimum.reduceat(loss, begins))
        if not rest:
            return out
        known, lines = self.solve(list({b for blocks in rest.values() for b in blocks})), iter(out)
        return [_joined([known[b] for b in rest[k]]) if k in rest else next(lines) for k in range(len(words))]

    def blocks(self, text: str) -> list[str | None]:
        """Blocks of a text. Its blanks become the vocabulary's blank sign, with one more in front;
        None stands for a sign that is in the text itself, which is spelled in bytes."""
        split = self.vocabulary.blocks.findall
        if BLANK not in text:
            return split(BLANK + text.replace(" ", BLANK))
        out = []
        for k, run in enumerate(text.split(BLANK)):
            out += [None] * (k > 0) + split((BLANK if not k else "") + run.replace(" ", BLANK))
        return out

    def _parts(self, texts: list[str]) -> tuple[list[bytes], list[str | None], int, np.ndarray, np.ndarray]:
        """Solved parts, each once; what they are parts of, and how many of these are words (the others are blocks of texts
        with the blank sign in them); the parts that the texts have, one text after the other; how many each has."""
        # words between single blanks, words after several blanks, and blocks
        kind = np.array([2 if not t or BLANK in t else int("  " in t or t[0] == " ") for t in texts], np.int8)
        several = [_WORDS.findall(" " + t) for t, k in zip(texts, kind) if k == 1]
        try:
            split = pc.split_pattern(pa.array([t for t, k in zip(texts, kind) if k == 0], pa.string()), " ")
            words = pa.concat_arrays([split.flatten(), pa.array([w for ws in several for w in ws], pa.string())])
        except UnicodeEncodeError:  # half of a surrogate pair; such texts go block by block
            kind, several = np.full(len(texts), 2, np.int8), []
            split, words = pa.array([], pa.list_(pa.string())), pa.array([], pa.string())
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts, number, own = self.solve_words(names), len(names), coded.indices.to_numpy()
        counts = np.zeros(len(texts), np.int64)
        counts[kind == 0] = pc.list_value_length(split).to_numpy()
        if kind.any():
            lists = [self.blocks(t) if t else [] for t, k in zip(texts, kind) if k == 2]
            counts[kind == 1], counts[kind == 2] = [*map(len, several)], [*map(len, lists)]
            place = {b: k for k, b in enumerate(dict.fromkeys(b for bs in lists for b in bs), number)}
            solved = {**self.solve([b for b in place if b is not None]), None: self.literal}
            names, parts = [*names, *place], [*parts, *[solved[b] for b in place]]
            of = np.argsort(np.repeat(kind, counts), kind="stable")
            every = np.zeros(len(of), np.int64)
            every[of] = np.concatenate((own, np.array([place[b] for bs in lists for b in bs], np.int64)))
            own = every
        return parts, names, number, own, counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts the ids of the best segmentations one after the other, how many each has, their
        scores, and what the next best of each loses (infinite if there is no other)."""
        parts, _, _, own, counts = self._parts(texts)
        return self._encoded(parts, own, counts)[:4]

    def _encoded(self, parts: list[bytes], own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of solved parts; then the first part of each text, where each part's ids begin, and what it loses."""
        words = np.frombuffer(b"".join(parts), np.int32)
        ends = np.cumsum([0, *map(len, parts)]) >> 2
        heads, sizes = ends[:-1][own], np.diff(ends)[own] - 1
        starts = np.concatenate(([0], np.cumsum(sizes)))
        ids = words[np.repeat(heads + 1 - starts[:-1], sizes) + np.arange(starts[-1])]
        losses = words[heads].view(np.float32)
        edges = np.concatenate(([0], np.cumsum(counts)))
        offsets = starts[edges]
        full = np.flatnonzero(counts)
        score, loss = np.zeros(len(counts)), np.full(len(counts), np.inf)
        if len(full):
            score[full] = np.add.reduceat(self.vocabulary.score_of_id[ids], offsets[full])
            loss[full] = np.minimum.reduceat(losses, edges[full])
        return ids, np.diff(offsets), score, loss, edges, starts, losses

    def ranked_all(self, texts: list[str], count: int) -> tuple[tuple, list[list[tuple[float, np.ndarray, bool]]]]:
        """What `encode_all` gives, and of each text the next best segmentations up to ``count`` in all: score, ids, and
        whether what was changed decodes to the same.

        They differ from the best one only in those parts that are among the ``count`` - 1 in which the next best
        loses least; these parts are searched by A-star for their own ``count`` best.
        """
        parts, names, number, own, counts = self._parts(texts)
        *best, edges, starts, losses = self._encoded(parts, own, counts)
        edges = edges.tolist()
        return tuple(best), [
            self._others(best[0], starts[a:b + 1], losses[a:b], own[a:b], names, number, score, count) if a < b else []
            for a, b, score in zip(edges, edges[1:], best[2].tolist())]

    def _others(self, ids, starts, losses, own, names, number, score, count) -> list[tuple[float, np.ndarray, bool]]:
        """The next best of a text whose parts begin at ``starts`` in ``ids``, with what the next best of each loses; parts
        are ``own`` of ``names``, of which the first ``number`` are words."""
        near = np.argsort(losses, kind="stable")[:count - 1] if count > 2 else np.array([int(np.argmin(losses))])
        # changes of parts, each (score lost, its place, the new ids); none of them is the best itself
        out: list[tuple[float, tuple]] = [(0.0, ())]
        for k in sorted(near[np.isfinite(losses[near])].tolist()):
            now = ids[starts[k]:starts[k + 1]].tolist()
            had = float(self.vocabulary.score_of_id[now].sum())
            found = self._options(names[own[k]], bool(own[k] < number), count + 1)
            options = [(had - s, (k, new)) for s, new in found if new != now][:count - 1]
            out = heapq.nsmallest(count, [*out, *[(lost + more, (*done, change)) for lost, done in out for more, change in options]],
                                  key=lambda x: x[0])
        made = []
        for lost, changes in out:
            if changes:
                pieces, at, same = [], starts[0], True
                for k, new in changes:
                    pieces += [ids[at:starts[k]], np.array(new, np.int32)]
                    at = starts[k + 1]
                    # parts hold whole characters, so a text comes back if its parts do
                    same = same and decode([0, *new], self.vocabulary) == decode([0, *ids[starts[k]:at].tolist()], self.vocabulary)
                made.append((score - lost, np.concatenate([*pieces, ids[at:starts[-1]]]), same))
        return made[:count - 1]

    def _options(self, name: str, word: bool, count: int) -> list[tuple[float, list[int]]]:
        """The best segmentations of a word or block, by A-star; those of short ones are kept."""
        key = name, word, count
        known = self.options.get(key)
        if known is None:
            known = self.nbest(name, count) if word else Lattice(name, self.vocabulary).paths(count)
            if len(self.options) >= MEMO // 8:
                self.options.clear()
            if len(name) <= 64:
                self.options[key] = known
        return known

    def encode(self, text: str) -> tuple[np.ndarray, float, float]:
        """Ids of the best segmentation, its score, and what the next best loses to it."""
        ids, _, score, loss = self.encode_all([text])
        return ids, float(score[0]), float(loss[0])

    def nbest(self, text: str, count: int) -> list[tuple[float, list[int]]]:
        """Scores and ids of the best segmentations, best first.

        The N best differ from the best one only in those blocks that are among
        the N - 1 in which the next best loses least.
        """
        if not text:
            return [(0.0, [])]
        raw = [self.vocabulary.bytes[b] for b in BLANK.encode()]
        lists = [
            [(self.vocabulary.byte_score * len(raw), raw)] if block is None else Lattice(block, self.vocabulary).paths(count)
            for block in self.blocks(text)]
        loss = {k: found[0][0] - found[1][0] for k, found in enumerate(lists) if len(found) > 1}
        near = set(heapq.nsmallest(count - 1, loss, key=lambda k: (loss[k], k)))
        out: list[tuple[float, tuple]] = [(0.0, ())]
        for k, found in enumerate(lists):
            options = found if k in near else found[:1]
            out = heapq.nsmallest(count, ((s + t, (*done, ids)) for s, done in out for t, ids in options),
                                  key=lambda x: -x[0])
        return [(s, [i for ids in done for i in ids]) for s, done in out]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(Vocabulary(path))


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of pieces."""
    plain, out, raw = vocabulary.plain, [], bytearray()
    if vocabulary.of_id.keys().isdisjoint(ids):
        return "".join([plain[i] for i in ids])[1:]
    for i in ids:
        text = plain[i]
        if text is None:
            raw.append(vocabulary.of_id[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
            raw.clear()
        out.append(text)
    out.append(raw.decode("utf-8", "surrogatepass"))
    return "".join(out)[1:]


def decode_all(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The same of many texts, whose pieces end at the ``offsets`` after the first; in bytes, the blank in front included."""
    pieces = vocabulary.raw.take(pa.array(ids, pa.int32()))
    _, ends, data = pieces.buffers()
    # an array without rows may have no buffers
    places = np.frombuffer(ends, np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(places[offsets].astype(np.int32)), data or pa.py_buffer(b"")])


def given_back(ids: np.ndarray, offsets: np.ndarray, texts: list[str], vocabulary: Vocabulary) -> list[bool]:
    """Whether the pieces of each text decode to it."""
    wanted = pa.array([utf8(" " + t) if t else b"" for t in texts], pa.binary())
    made = decode_all(ids, offsets, vocabulary)
    # the blank in front is spelled in bytes where the vocabulary has none
    return [same or made[k].as_py() == utf8(BLANK + texts[k]) for k, same in enumerate(pc.equal(made, wanted).to_pylist())]


def encoded(
    docs: DataFrame, keys: list[str], *, path: str, text: str = "text", verify: bool = False, count: int = 1,
) -> DataFrame:
    """``keys``, ``ids``, ``score`` and ``margin`` (to the next best segmentation; null if there is no other).

    With a ``count`` of two or more also ``others``: the next best segmentations, best first, ``count`` in all with
    the best one (fewer if there are no more), each with ``ids`` and ``score``.
    With ``verify`` also ``round_trip``: whether the pieces decode to the text, those of all segmentations.
    """
    kinds = dict(docs.dtypes)

    def start():
        own = encoder(path)

        def work(columns):
            texts = [t or "" for t in columns[-1]]
            more = None
            if count > 1:
                (ids, sizes, score, loss), more = own.ranked_all(texts, count)
            else:
                ids, sizes, score, loss = own.encode_all(texts)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            out = [*columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(score),
                   pa.array(loss, mask=np.isinf(loss))]
            if more is not None:
                flat = [o for found in more for o in found]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *[len(i) for _, i, _ in flat]]).astype(np.int32)),
                    pa.array(np.concatenate([i for _, i, _ in flat]) if flat else np.zeros(0, np.int32), pa.int32()))
                each = pa.StructArray.from_arrays([lists, pa.array([s for s, _, _ in flat], pa.float64())], names=["ids", "score"])
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, more)]).astype(np.int32)), each))
            if verify:
                same = given_back(ids, offsets, texts, own.vocabulary)
                if more is not None:
                    same = [ok and all(kept for _, _, kept in found) for ok, found in zip(same, more)]
                out.append(same)
            return out
        return work

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ids array<int>, score double, margin double"
    schema += ", others array<struct<ids: array<int>, score: double>>" if count > 1 else ""
    schema += ", round_trip boolean" if verify else ""
    return map_texts(docs, [*keys, text], schema, start)


def decoded(rows: DataFrame, keys: list[str], *, path: str, ids: str = "ids") -> DataFrame:
    """``keys`` and ``text`` of rows with ids; null ids give an empty text."""
    kinds = dict(rows.dtypes)

    def start():
        vocabulary = encoder(path).vocabulary
        return lambda columns: [*columns[:-1], [decode(i or (), vocabulary) for i in columns[-1]]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string"
    return map_texts(rows, [*keys, ids], schema, start)
