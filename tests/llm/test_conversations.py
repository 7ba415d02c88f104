"""Repair against a plain search over all edit strings, for conversations in one piece and in many."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import conversations as c


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if k == 0:
            out.append((conv, None))
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, (turn, "user" if k == 4 else role, text))] * (2 if k == 3 else 1)
    return out


def plain_best(rows):
    """(cost, audit) for (role initial, must go, truncated)."""

    @functools.cache
    def best(i, state, inserts=0):
        found = [(0, "")] if i == len(rows) and state in "-a" else []
        turn = "a" if state == "u" else "u"
        if inserts < 3:
            cost, audit = best(i, turn, inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(rows):
            first, gone, cut = rows[i]
            cost, audit = best(i + 1, state)
            found.append((cost + 3, "D" + audit))
            if not gone:
                if first == turn or first == "s" and state == "-":
                    cost, audit = best(i + 1, first)
                    found.append((cost + cut, "K" + audit))
                cost, audit = best(i + 1, turn)
                found.append((cost + 2 + cut, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, "-")


def plain_repair(pairs):
    """One row for each conversation; pairs of (conv, row or None)."""
    convs: dict = {}
    for conv, row in pairs:
        convs.setdefault(conv, []).extend([row] if row else [])
    out = []
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, n, coded = set(), [0, 0, 0], []
        for _, role, text in rows:
            ends = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not ends else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                n[fault] += 1
            coded.append((role[:1], fault < 2, int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        turns = {r[0] for r in rows if r[0] is not None}
        cost, audit = plain_best(tuple(coded))
        lines, state, i = [], "-", 0
        for x in audit:
            role = "assistant" if state == "u" else "user"
            if x == "I":
                lines.append(f"{role}:")
            else:
                if x != "D":
                    role = rows[i][1] if x == "K" else role
                    lines.append(f"{role}:{rows[i][2]}")
                i += 1
            state = role[0] if x != "D" else state
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def make_convs(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else rng.choice([None, "", "tool", "system"]) if rng.random() < 0.1 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", " \n\x0b", "same.", "same", "no stop", "é…", "yes! \t", "no?"]) if rng.random() < 0.5 else f"text {rng.random()}."
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 3]), role, text))
    rows += [rows[0], rows[0], rows[50], (None, 1, "user", "null."), (None, None, "assistant", "null too."), (None,) * 4, (99, 5, "system", "x" * 200_000 + ".")]
    rows += [(77, 3, "user", "the same row.")] * 90  # more than a segment of one row
    return rows


@pytest.mark.parametrize("size", [1, 7, 256])
def test_repair(spark, size):
    rows = make_convs()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int").repartition(5)
    got = sorted(map(tuple, c.repair(c.damage(df), size).collect()), key=repr)
    assert got == plain_repair(plain_damage(rows))
    undamaged = sorted(map(tuple, c.repair(df, size).collect()), key=repr)
    whole = [(r[0], (r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")) for r in rows]
    assert undamaged == plain_repair(whole)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = sorted(map(tuple, c.repair(c.damage(df)).collect()), key=repr)
    assert got == plain_repair(plain_damage([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]))
    assert any(r[5] for r in got)


def test_turns(spark, sf):
    df = c.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    lines: dict = {}
    for r in sorted(c.repaired_turns(df, 3).collect(), key=lambda r: (r["conv_id"], r["part"], r["idx"], r["seq"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in c.repair(df).collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_all_rows_dropped_and_empty(spark):
    gone = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "b.", None), (3, 1, "user", " ", False)], "conv_id long, turn long, role string, text string, gone boolean")
    found = {r["conv_id"]: r for r in c.repair(gone).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(found[1]) == (1, 0, 0, 0, 0, 0, 0, "", nothing)
    assert (found[2]["audit"], found[2]["cost"], found[3]["audit"], found[3]["repaired_sha256"]) == ("KI", 2, "D", nothing)
    assert c.repair(gone.where("false")).collect() == []
    assert c.repaired_turns(gone.where("false")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=9), st.integers(0, 9))
def test_auction_in_pieces(codes, at):
    """The cheapest edits of two segments by their costs are those of both in one."""
    codes = bytes(x & ~c.TRUNCATED if x & c.GONE else x for x in codes)
    rows = tuple((" sua"[x & 3], bool(x & c.GONE), int(bool(x & c.TRUNCATED))) for x in codes)
    lattice = c.Lattice(codes, c.AHEAD)
    letters, end = lattice.edits(c.START)
    assert (lattice.price[c.START], letters + c.TAIL[end]) == plain_best(rows)
    a, b = codes[:at], codes[at:]
    between = [c.costs_between(x) for x in (a, b)]
    ahead = [min(between[1][4 * i + j] + c.AHEAD[j] for j in range(4)) for i in range(4)]
    first = c.Lattice(a, ahead).edits(c.START)
    second = c.Lattice(b, c.AHEAD).edits(first[1])
    assert first[0] + second[0] + c.TAIL[second[1]] == letters + c.TAIL[end]


def test_long_and_all_bad():
    lattice = c.Lattice(bytes([c.USER, c.GONE, c.ASSISTANT | c.TRUNCATED] * 85), c.AHEAD)
    assert lattice.edits(c.START) == ("KDK" * 85, c.ASSISTANT)
    assert lattice.price[c.START] == 85 * 4
    assert c.Lattice(bytes([c.USER] * 256), c.AHEAD).edits(c.START)[0].count("R") == 128
