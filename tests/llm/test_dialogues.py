from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from kinetable.llm import dialogues, queries

SCHEMA = "conv_id long, turn long, role string, text string, id int, cost string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\f\r"


def least_by_automaton(codes):
    """Cheapest (cost, audit) read from left to right: state 0 nothing yet, s, u, a."""
    after = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        todo = list(best)
        while todo:
            state = todo.pop()
            for role in "ua":
                to = after[state].get(role)
                new = (best[state][0] + 5, best[state][1] + "I")
                if to and new < best.get(to, (10**9,)):
                    best[to] = new
                    todo.append(to)
        return best

    best = inserted({"0": (0, "")})
    for code in codes:
        nxt = {}
        for state, (cost, audit) in best.items():
            moves = [(state, cost + 2, "D")]
            if code != "x":
                more = 5 * code.isupper()
                for role in "sua":
                    to = after[state].get(role)
                    if to and role == code.lower():
                        moves.append((to, cost + more, "K"))
                    if to and role != "s":
                        moves.append((to, cost + 1 + more, "R"))
            for to, c, step in moves:
                nxt[to] = min(nxt.get(to, (10**9,)), (c, audit + step))
        best = inserted(nxt)
    return min(best[s] for s in ("0", "a") if s in best)


def by_trying_all(codes):
    """All edits of a few turns with up to three insertions."""
    found = []
    for steps in itertools.product(*[["D"] if c == "x" else ["D", "K", "R"] for c in codes]):
        for places in itertools.chain(*[itertools.combinations_with_replacement(range(len(codes) + 1), k) for k in range(4)]):
            audit, options, cost = "", [""], 5 * len(places)
            for i in range(len(codes) + 1):
                audit += "I" * places.count(i)
                options = [o + "".join(r) for o in options for r in itertools.product("ua", repeat=places.count(i))]
                if i < len(codes):
                    step, code = steps[i], codes[i]
                    audit += step
                    cost += {"D": 2, "K": 0, "R": 1}[step] + 5 * (step != "D" and code.isupper())
                    if step != "D":
                        options = [o + r for o in options for r in (code.lower() if step == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def brute(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role, text, turn))
    out = {}
    for conv, turns in of.items():
        turns.sort(key=lambda t: t[:4])
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, _, role, text, _ in turns:
            core, again = text.strip(SPACE), (role, text) in seen
            seen.add((role, text))
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            cut = bool(core) and core[-1] not in ".!?"
            fault = 0 if not core else 1 if again else 2 if cut else None
            if fault is not None:
                counts[fault] += 1
            codes += "x" if fault in (0, 1) else first.upper() if cut else first
        cost, audit = least_by_automaton(codes)
        known = [t[4] for t in turns if t[4] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        lines, at, role = [], 0, "user"
        for step in audit:
            own, text = turns[at][2:4] if step != "I" else (None, "")
            at += step != "I"
            if step == "D":
                continue
            system = step == "K" and own[0] == "s"
            lines.append(f"{own if step == 'K' else role}:{text}")
            role = role if system else "assistant" if role == "user" else "user"
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def random_turns(seed, convs, most):
    random.seed(seed)
    texts = ["Hi.", "Yes!", "no", "", " \n", "Well? \t", "more, then", ".", "Fin.x"]
    roles = ["user", "assistant", "system", "u", "a", "tool", "", None, "User"]
    rows = []
    for conv in range(convs):
        for i in range(random.randint(1, most)):
            rows.append((conv or None, random.choice([None, i, i, i, i // 2, 3 * i]),
                         random.choice(["user", "assistant"] if random.random() < .8 else roles),
                         random.choice(texts) if random.random() < .3 else random.choice([None, f"t{i}.", f"t{i}.", f"t{i}", f"t{i // 3}?"])))
    return rows


def test_parser_against_all_edits():
    for n in range(4):
        for codes in itertools.product("xsuaoUS", repeat=n):
            codes = "".join(codes)
            assert dialogues.repaired_codes(codes) == least_by_automaton(codes) == by_trying_all(codes), codes


def test_parser_on_long_conversations_and_any_cut():
    random.seed(5)
    for n in (7, 16, 17, 33, 90, 300):
        codes = "".join(random.choices("xsuaoSUAO", [2, 1, 6, 6, 1, 1, 2, 2, 1], k=n))
        want = least_by_automaton(codes)
        assert dialogues.repaired_codes(codes) == want
        cells, at = [], 0
        while at < n:
            size = random.randint(1, 9)
            cells.append(dialogues.combined([dialogues.leaf(c) for c in codes[at:at + size]]))
            at += size
        assert dialogues.cheapest(dialogues.parsed(cells)) == want


@pytest.mark.parametrize("whole", [256, 3, 0])
def test_reports_against_a_plain_loop(spark, whole):
    rows = random_turns(whole, 40, 24)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = found(dialogues.repaired(table(spark, rows), whole=whole))
    assert got == brute(plain)


def test_long_conversations_over_many_tasks(spark):
    random.seed(8)
    rows = [(7, i, random.choice(["user", "assistant"]), random.choice([f"{i}.", f"{i}", "same.", ""])) for i in range(2500)]
    rows += [(7, 5000, "user", "copy.")] * 700 + [(None, None, "user", "all the same.")] * 900 + [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo.")]
    df = table(spark, rows).repartition(5)
    assert found(dialogues.repaired(df)) == brute(rows)
    turns = dialogues.long_turns(df.where("conv_id = 7")).orderBy("place").collect()
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == brute(rows)[7][-1]


def of_query(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    return found(queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)))


def expected(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    return out | brute(damaged(rows))


def test_query_against_brute_force_on_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01")) == expected(rows)


def test_query_on_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rows = random_turns(99, 60, 9) + [(None, None, None, None)] * 3 + [(500, 1, "user", "x" * 200_000 + "."), (500, 2, "assistant", "y" * 200_000)]
    rows += [(600, 0, "system", "Be brief."), (600, 0, "system", "Be brief.")] + [(c, 0, "user", "gone?") for c in range(700, 760)]
    assert of_query(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert of_query(spark, [], tmp_path) == {}
