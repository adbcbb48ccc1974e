"""Repair of conversations by weighted interval parsing.

A repaired conversation has roles ``(s?(ua)+)?``: an optional system turn, then
user and assistant by turns, or nothing. Each turn is kept (K, no cost), given
another of the roles user and assistant (R, 1) or deleted (D, 2); turns without
text and turns said before must be deleted; an empty turn can be inserted (I, 5);
a truncated turn that stays costs 5 more. The cheapest edits are found by
Cocke-Younger-Kasami parsing with a grammar in Chomsky normal form. Its symbols
are the parts that such a sequence can be cut into, named by first and last
role: ``E`` (nothing left), ``uu`` (from user to user), ``ua``, ``au``, ``aa``, ``s``,
``su`` and ``sa``. A cell has the least (cost, audit) of each symbol over a span of
turns; spans are combined by growing length, every cell closed under insertions
at both ends. Equal cost is settled by the audit, the initials of the edits: no
audit of equal cost begins another, so the least one is made of least parts.

As every part of a sequence has a symbol, the cells of neighbouring spans give
those of both: a long conversation is parsed in spans of ``FAN`` turns, and these
spans again, until one is left. Conversations of over ``whole`` turns do so as
Spark jobs, level by level: no task gets all turns of one. Their turns are
numbered by a sort over ranges, copies of a turn count as one row. What is
sequential by nature is the SHA-256 of a repaired text, which is fed turn by turn.

Defined results: rows go by turn (nulls first), then role and text; null role and
text count as one space; rows without an id are one conversation; repeated rows
are duplicates; a conversation without rows has zeros and no audit; texts of any
length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetable.llm.common import small_batches
from kinetable.settings import checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAN, WHOLE = 16, 256
ROLES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
ENDS = ("E", "ua", "sa")  # what a whole conversation may be
SYMBOLS = ("E", "uu", "ua", "au", "aa", "s", "su", "sa")

Cell = dict[str, tuple[int, str]]


def _joined(left: str, right: str) -> str | None:
    """The symbol of two neighbouring parts, if they go together."""
    if "E" in (left, right):
        return right if left == "E" else left
    if right[0] == "s" or right[0] != ("u" if left == "s" else OTHER[left[-1]]):
        return None
    return left[0] + right[-1]


RULES = [(a, b, c) for a in SYMBOLS for b in SYMBOLS if (c := _joined(a, b))]
_INSERTED = ("uu", "aa")


def _better(cell: Cell, symbol: str, cost: int, audit: str) -> bool:
    had = cell.get(symbol)
    if had is None or cost < had[0] or cost == had[0] and audit < had[1]:
        cell[symbol] = cost, audit
        return True
    return False


def closed(cell: Cell) -> Cell:
    """With turns inserted at either end, where that is cheaper."""
    todo = list(cell)
    while todo:
        symbol = todo.pop()
        cost, audit = cell[symbol]
        for new in _INSERTED:
            for made, text in ((_joined(new, symbol), "I" + audit), (_joined(symbol, new), audit + "I")):
                if made and _better(cell, made, cost + INSERT, text):
                    todo.append(made)
    return cell


@lru_cache(maxsize=None)
def leaf(code: str) -> Cell:
    """The cell of one turn: ``x`` must go; else the initial of its role (``o`` for others), a capital if truncated."""
    cell: Cell = {"E": (DELETE, "D")}
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        role = code.lower()
        for r in "ua":
            cell[r + r] = (KEEP + more, "K") if role == r else (REROLE + more, "R")
        if role == "s":
            cell["s"] = KEEP + more, "K"
    return closed(cell)


def deleted(count: int) -> Cell:
    """The cell of so many turns that must go."""
    return closed({"E": (DELETE * count, "D" * count)})


def combined(cells: list[Cell]) -> Cell:
    """All neighbouring cells as one: every span from every split, the shorter spans first."""
    n = len(cells)
    table = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: Cell = {}
            for k in range(i + 1, i + length):
                left, right = table[i, k], table[k, i + length]
                for a, b, c in RULES:
                    if a in left and b in right:
                        (x, p), (y, q) = left[a], right[b]
                        had = best.get(c)
                        if had is None or x + y < had[0] or x + y == had[0] and p + q < had[1]:
                            best[c] = x + y, p + q
            table[i, i + length] = closed(best)
    return table[0, n]


def parsed(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        cells = [combined(cells[i:i + FAN]) for i in range(0, len(cells), FAN)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[s] for s in ENDS if s in cell)


@lru_cache(maxsize=1 << 16)
def repaired_codes(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation, given one code a turn."""
    return cheapest(parsed([leaf(c) for c in codes])) if codes else (0, "")


def edits(codes: str, audit: str) -> Iterator[tuple[int | None, str | None]]:
    """What is left, in order: the place of the turn (None if inserted) and its new role (None if it keeps its own)."""
    at, role = 0, "u"
    for step in audit:
        if step == "D":
            at += 1
        elif step == "K" and codes[at].lower() == "s":
            yield at, None
            at += 1
        else:
            yield (None if step == "I" else at), (None if step == "K" else ROLES[role])
            at, role = at + (step != "I"), OTHER[role]


# --- turns --------------------------------------------------------------------

BLANK, CUT = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with one of 20 faults drawn by the checksum of id and turn; most stay as they are."""
    text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    plain = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), text_of(role).alias("role"),
                        text_of(text).alias("text"), draw.alias("draw")).where("draw != 0")
    said = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return plain.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.when(F.col("draw") == 4, "user").otherwise(
        F.col("role")).alias(role), said.alias(text), copies.alias("_copy")).drop("_copy")


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``no_id, id, turn, role, text`` and ``code``: what the parser has to know of a turn, but for duplicates."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    first = F.substring("role", 1, 1)
    named = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return rows.select(
        F.col(f"`{conv}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit("")).alias("id"),
        F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
    ).withColumn("code", F.when(~F.col("text").rlike(BLANK), "b").when(F.col("text").rlike(CUT), named).otherwise(F.upper(named)))


_REPORT = ("no_id boolean, id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, turns array<struct<role: string, text: string>>")
_LEGAL = {"su", "ua", "au"}


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Report and repaired turns of each conversation; rows come sorted by conversation and place in it."""
    kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 6, pa.string(),
             pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = [part.split()[0] for part in _REPORT.split(", ", 9)]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    out, weight = [], 0
    for (no_id, name), group in groupby(rows(), key=lambda r: r[:2]):
        turns = [r[2:] for r in group]
        out.append((no_id, name, *_one(turns)))
        weight += sum(len(t[2]) for t in turns) + 200
        if weight > 1 << 22:
            yield made(out)
            out, weight = [], 0
    if out:
        yield made(out)


def _one(turns: list[tuple]) -> tuple:
    seen, codes, counts = set(), [], {"b": 0, "d": 0, "t": 0}
    for _, role, text, code in turns:
        fault = "b" if code == "b" else "d" if (role, text) in seen else "t" if code.isupper() else None
        if fault:
            counts[fault] += 1
        codes.append("x" if fault in ("b", "d") else code)
        seen.add((role, text))
    cost, audit = repaired_codes("".join(codes))
    known = {t[0] for t in turns if t[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(turns, turns[1:]))
    left = [{"role": role or turns[at][1], "text": "" if at is None else turns[at][2]} for at, role in edits("".join(codes), audit)]
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, left


# --- conversations of any length ----------------------------------------------

_KEY = ["no_id", "id"]


def numbered(turns: DataFrame) -> DataFrame:
    """Copies as one row with ``copies``; ``at``: the place of the first one in its conversation; ``before``: the
    initial of the role before it."""
    once = turns.groupBy(*_KEY, "turn", "role", "text", "code").agg(F.count("*").alias("copies"))
    order = [*_KEY, "turn", "role", "text"]
    schema = "no_id boolean, id string, turn long, role string, text string, code string, copies long, part int, at long, before string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, at, before = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            places, roles = [], []
            columns = {n: batch.column(n).to_pylist() for n in ("no_id", "id", "role", "copies")}
            for *name, role, copies in zip(*columns.values()):
                if name != last:
                    last, at, before = name, 0, None
                places.append(at)
                roles.append(before)
                at, before = at + copies, role[:1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(roles, pa.string())],
                names=[*batch.schema.names, "part", "at", "before"])

    # ranges by the beginning of a text, which agrees with its order
    ranges = [*order[:-1], F.substring("text", 1, 64)]
    inside = checkpointed(small_batches(once).repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(count, schema))
    # one row for each conversation and task
    along = Window.partitionBy(*_KEY).orderBy("part")
    parts = inside.groupBy(*_KEY, "part").agg(
        F.sum("copies").alias("n"), F.max_by(F.substring("role", 1, 1), "at").alias("last")).select(
        *_KEY, "part", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.lag("last").over(along).alias("last"))
    return inside.join(parts, [*_KEY, "part"]).withColumns(
        {"at": F.col("at") + F.col("start"), "before": F.coalesce("before", "last")}).drop("part", "start", "last")


_CELL = "array<struct<symbol: string, cost: long, audit: string>>"


def _as_cell(rows: list[dict]) -> Cell:
    return {r["symbol"]: (r["cost"], r["audit"]) for r in rows}


def _of_cell(cell: Cell) -> list[dict]:
    return [{"symbol": s, "cost": c, "audit": a} for s, (c, a) in cell.items()]


def _level(spans: DataFrame, read) -> DataFrame:
    """Neighbouring spans, ``FAN`` at a time, as one; ``read`` makes a cell of what a span has in ``part``."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, lists = batch.columns
            cells = pa.array([_of_cell(combined([read(r["part"]) for r in x])) for x in lists.to_pylist()], pa.list_(
                pa.struct([("symbol", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])))
            yield pa.RecordBatch.from_arrays([*names, cells], names=["no_id", "id", "span", "part"])

    grouped = spans.groupBy(*_KEY, F.floor(F.col("span") / FAN).alias("span")).agg(
        F.sort_array(F.collect_list(F.struct("span", "part"))).alias("parts"))
    return small_batches(grouped).mapInArrow(combine, f"no_id boolean, id string, span long, part {_CELL}")


def _row_cell(part: dict) -> Cell:
    copies = part["copies"] - 1
    first = leaf(part["code"])
    return first if not copies else combined([first, deleted(copies)])


def _long(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns ``(no_id, id, place, role, text)``, each step dealt by conversation and place."""
    rows = numbered(turns).withColumn("said", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256))
    first = rows.groupBy(*_KEY, "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = checkpointed(rows.join(first, [*_KEY, "said"], "left").withColumn(
        "again", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).withColumn(
        "place", F.when((F.col("code") == "b") | F.col("again"), "x").otherwise(F.col("code"))).drop("first", "said"))

    # bottom up; places may skip numbers where copies are, so spans are counted anew on each level
    spans = rows.select(*_KEY, F.col("at").alias("span"), F.struct(F.col("place").alias("code"), "copies").alias("part"))
    spans = checkpointed(_level(spans, _row_cell))
    while spans.where("span > 0").limit(1).count():
        spans = checkpointed(_level(spans, _as_cell))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cheapest(_as_cell(c)) for c in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("no_id"), batch.column("id"), pa.array([c for c, _ in found], pa.int64()),
                 pa.array([a for _, a in found], pa.string())], names=["no_id", "id", "cost", "audit"])

    chosen = checkpointed(spans.mapInArrow(choose, "no_id boolean, id string, cost long, audit string"))
    return _long_report(rows, chosen), _long_turns(rows, chosen)


def _long_report(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    extra, pair = F.col("copies") - 1, F.concat("before", F.substring("role", 1, 1))
    is_blank, cut = F.col("code") == "b", F.upper("code") == F.col("code")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0)
    counts = rows.groupBy(*_KEY, "turn").agg(
        total(F.when(is_blank, F.col("copies"))).alias("blank"),
        total(F.when(~is_blank, extra + one(F.col("again")))).alias("duplicate"),
        total(one(~is_blank & ~F.col("again") & cut)).alias("truncated"),
        total(extra + one(F.col("before").isNotNull() & ~pair.isin(*sorted(_LEGAL)))).alias("illegal"))
    report = counts.groupBy(*_KEY).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    return report.join(chosen, _KEY)


def _long_turns(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["no_id", "id", "at", "step", "place"]
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for no_id, name, audit in zip(*[c.to_pylist() for c in batch.columns]):
                at, held = 0, []
                for place, step in enumerate(audit):
                    if step != "D":
                        held.append((no_id, name, None if step == "I" else at, step, place))
                    at += step != "I"
                    if len(held) >= 10_000 or held and place + 1 == len(audit):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []

    left = chosen.select(*_KEY, "audit").mapInArrow(steps, "no_id boolean, id string, at long, step string, place long")
    stays = left.where("at IS NOT NULL").join(rows.select(*_KEY, "at", "role", "text"), [*_KEY, "at"])
    put = left.where("at IS NULL").withColumns({"role": F.lit(""), "text": F.lit("")})
    columns = [*_KEY, "place", "step", "role", "text"]
    return stays.select(*columns).unionByName(put.select(*columns))


_LINE = "no_id boolean, id string, place long, role string, text string"


def _in_order(turns: DataFrame, schema: str, make) -> DataFrame:
    """Feed the turns of each conversation to ``make``, in order and one by one."""
    return small_batches(turns).repartition(*_KEY).sortWithinPartitions(*_KEY, "place").mapInArrow(make, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of ``role:text`` lines in constant memory; the role of a turn follows from those before it."""
    names, last, hasher, role, begun = ["no_id", "id", "repaired_sha256"], None, None, "u", False
    kinds = [pa.bool_(), pa.string(), pa.string()]

    def made():
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, hasher.hexdigest()), kinds)], names=names)

    for batch in batches:
        for no_id, name, _, step, own, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (no_id, name) != last:
                if last is not None:
                    yield made()
                last, hasher, role, begun = (no_id, name), hashlib.sha256(), "u", False
            system = step == "K" and own[:1] == "s"
            line = f"{own if step == 'K' else ROLES[role]}:{text}"
            hasher.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
            role, begun = role if system else OTHER[role], True
    if last is not None:
        yield made()


def repaired(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             whole: int = WHOLE) -> DataFrame:
    """``conv``, the counts of faults, ``cost``, ``audit``, ``turns`` (repaired, an array of role and text; null for
    conversations of over ``whole`` rows, whose turns `long_turns` gives) and ``repaired_sha256``."""
    kind = dict(rows.dtypes)[conv]
    turns = _turns(rows, conv, turn, role, text)
    large = checkpointed(turns.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > whole).drop("n"))
    some = not large.isEmpty()
    short = turns.join(large, _KEY, "left_anti") if some else turns
    order = [*_KEY, "turn", "role", "text"]
    report = small_batches(short).repartition(*_KEY).sortWithinPartitions(*order).mapInArrow(_short, _REPORT)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    report = report.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256))
    if some:
        reports, left = _long(turns.join(large, _KEY, "left_semi"))
        digest = _in_order(left, "no_id boolean, id string, repaired_sha256 string", _digests)
        reports = reports.join(digest, _KEY, "left").withColumns({
            "turns": F.lit(None).cast(dict(report.dtypes)["turns"]),
            "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
        report = report.unionByName(reports)
    named = F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(conv)
    return report.select(named, *[c for c in report.columns if c not in _KEY])


def long_turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired turns of conversations of any length, as rows: ``conv``, ``place`` (growing), ``role`` and ``text``."""
    kind = dict(rows.dtypes)[conv]
    _, left = _long(_turns(rows, conv, turn, role, text))
    named = F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(conv)
    return _in_order(left, _LINE, _roles).select(named, "place", "role", "text")


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, role = None, "u"
    for batch in batches:
        roles = []
        for no_id, name, step, own in zip(*[batch.column(c).to_pylist() for c in ("no_id", "id", "step", "role")]):
            if (no_id, name) != last:
                last, role = (no_id, name), "u"
            system = step == "K" and own[:1] == "s"
            roles.append(own if step == "K" else ROLES[role])
            role = role if system else OTHER[role]
        yield pa.RecordBatch.from_arrays(
            [batch.column("no_id"), batch.column("id"), batch.column("place"), pa.array(roles, pa.string()), batch.column("text")],
            names=["no_id", "id", "place", "role", "text"])
