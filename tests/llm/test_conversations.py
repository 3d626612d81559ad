"""Conversation repair against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cohortlens.llm import conversation_repair as cr

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, position bigint, block int, cost string, kind int, `at` int, initial string"
LEGAL = {"su", "ua", "au"}
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAME = {"u": "user", "a": "assistant"}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def edits_of(row, state):
    """(cost, letter, state after, line) of everything that may be done with a row."""
    role, text, fault = row
    out = [(4, "D", state, None)]
    if fault not in ("blank", "duplicate"):
        late = 3 * (fault == "truncated")
        out += [(late, "K", STEP[state, role[:1]], f"{role}:{text}")] if (state, role[:1]) in STEP else []
        out += [(late + 3, "R", STEP[state, r], f"{NAME[r]}:{text}") for r in "ua" if (state, r) in STEP]
    return out


def inserts(state):
    """(cost, letters, state, lines) of up to three rows put in."""
    lines = ()
    yield 0, "", state, lines
    for k in range(1, 4):
        r = "a" if state == "u" else "u"
        state, lines = STEP[state, r], lines + (NAME[r] + ":",)
        yield 3 * k, "I" * k, state, lines


def exhaustive(rows, bound):
    """Every way within the bound: (cost, audit, lines)."""
    def go(i, state, cost, audit, lines):
        if cost > bound:
            return
        for more, letters, after, new in inserts(state):
            if i == len(rows):
                if after in ("", "a") and cost + more <= bound:
                    yield cost + more, audit + letters, lines + new
            else:
                for c, letter, then, line in edits_of(rows[i], after):
                    yield from go(i + 1, then, cost + more + c, audit + letters + letter, lines + new + ((line,) if line is not None else ()))
    return go(0, "", 0, "", ())


def by_strings(rows):
    """The least (cost, audit, lines) for each state, row by row, with whole strings."""
    best = {"": (0, "", ())}
    for row in [*rows, None]:
        now = {}
        for state, (cost, audit, lines) in best.items():
            for more, letters, after, new in inserts(state):
                for c, letter, then, line in edits_of(row, after) if row else [(0, "", after, None)]:
                    x = (cost + more + c, audit + letters + letter, lines + new + ((line,) if line is not None else ()))
                    now[then] = min(now.get(then, x), x)
        best = now
    return min(best[s] for s in ("", "a") if s in best)


def brute_best(rows):
    cost, audit, lines = by_strings(rows)
    if len(rows) <= 4:
        assert (cost, audit, lines) == min(exhaustive(rows, cost))
    return cost, audit, "\n".join(lines)


def brute(original):
    rows = brute_damage(original)
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = {r[1] for r in own if r[1] is not None}
        seen, faults = set(), []
        for _, _, role, text in own:
            chars = WORD.findall(text)
            faults.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit, text = brute_best([(r[2], r[3], f) for r, f in zip(own, faults)])
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "system"])
            text = rng.choice(["Yes.", "No", "", " \t", None, "Why?  \n", f"line {rng.randrange(4)}.\nmore", "é!"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def result(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 1, 2, "c", 3, 4, "i") for r in rows], SCHEMA)
    got = cr.report(frame, cr.repair(cr.damaged(frame), **settings))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@lru_cache
def small():
    rows = conversations(1, 40, 9)
    return rows + rows[5:9]


@pytest.mark.parametrize("settings", [{}, {"block": 7}, {"block": 2, "fan": 2}, {"block": 1, "fan": 3}])
def test_repairs_equal_an_exhaustive_search(spark, settings):
    assert result(spark, small(), **settings) == brute(small())


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "other"]), f"Text {rng.randrange(200)}" + rng.choice(["", ".", "!"])) for t in range(300)]
    rows += conversations(2, 5, 6)
    assert result(spark, rows, block=16, fan=4) == brute(rows)


def test_empty_table_and_very_long_text(spark):
    assert result(spark, []) == []
    rows = [(1, 1, "user", "word " * 200_000 + "end."), (1, 2, "assistant", " " * 300_000 + "a?" + "\n" * 300_000), (2, None, None, None)]
    assert result(spark, rows) == brute(rows)


def test_repaired_rows_read_as_the_pattern(spark):
    frame = spark.createDataFrame(small(), "conv_id bigint, turn bigint, role string, text string")
    roles = {}
    for r in sorted(cr.repaired(cr.repair(cr.damaged(frame))).collect(), key=lambda r: (r.position, r.number)):
        roles.setdefault(r.conv_id, []).append(r.role[0])
    assert roles and all(re.fullmatch("s?(ua)+", "".join(x)) for x in roles.values())


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    got = cr.op11_conversation_repair(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
