"""Conversation repair: the chart against all edit sequences, pieces against wholes, the operator against a plain state machine."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from parity import connect, difference

from halocline.llm import conversations as cv

ROW = "conv_id long, turn long, role string, text string"


def all_edits(codes):
    """Least (cost, audit) over every sequence of edits with at most two insertions at a place."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    options = []
    for c in codes:
        options.append([("D", 2, "")])
        if c != "x":
            more, role = 5 * c.isupper(), c.lower()
            options[-1] += [("R", 1 + more, "u"), ("R", 1 + more, "a"), ("K", more, role if role in "sua" else "x")]
    for rows in itertools.product(*options):
        for g in itertools.product(gaps, repeat=len(codes) + 1):
            cost = sum(r[1] for r in rows) + 5 * sum(map(len, g))
            if best and cost > best[0]:
                continue
            roles = "".join(g[0]) + "".join(r[2] + "".join(x) for r, x in zip(rows, g[1:]))
            if re.fullmatch(r"(s?(ua)+)?", roles):
                audit = "I" * len(g[0]) + "".join(r[0] + "I" * len(x) for r, x in zip(rows, g[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", range(4))
def test_chart_finds_the_cheapest_edits(n):
    rng = random.Random(n)
    for _ in range(30):
        codes = "".join(rng.choice("uasoUASOx") for _ in range(n))
        assert cv.cheapest(cv.span_cells(codes)) == all_edits(codes), codes


def machine(rows):
    """Cheapest repair by a shortest path over (row, last role): (cost, audit, repaired turns)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def offer(new, role, state):
        if role not in new or state[:2] < new[role][:2]:
            new[role] = state

    def inserted(states):
        for _ in range(3):
            for last, (c, a, t) in list(states.items()):
                for r in set(follow[last]) - {"s"}:
                    offer(states, r, (c + 5, a + "I", (*t, f"{cv.ROLES[r]}:")))
        return states

    states = inserted(states)
    for code, role, text in rows:
        new = {}
        for last, (c, a, t) in states.items():
            offer(new, last, (c + 2, a + "D", t))
            if code != "x":
                more = 5 * code.isupper()
                for r in follow[last]:
                    if role[:1] == r:
                        offer(new, r, (c + more, a + "K", (*t, f"{role}:{text}")))
                    if r != "s":
                        offer(new, r, (c + 1 + more, a + "R", (*t, f"{cv.ROLES[r]}:{text}")))
        states = inserted(new)
    return min(s for r, s in states.items() if r in ("", "a"))


def expected(rows):
    """The operator's rows, computed one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            live += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, coded, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in live:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            coded.append(("x" if fault in ("blank", "duplicate") else code.upper() if fault else code, role, text))
        turns = [t for t, _, _ in live if t is not None]
        cost, audit, made = machine(coded)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *counts.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in cv.repair_conversations(df).collect()}


def some_rows(rng, conv, n):
    texts = ["Yes.", "No!", "And?", "cut off", "", " \n", "Yes. \t", "ünïcode…", None, "a\nb."]
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.3 else i, rng.choice(["user", "assistant", "system", "tool", "", None, "usr"]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_repair_matches_a_state_machine(spark, partitions):
    rng = random.Random(partitions)
    rows = [r for c in range(60) for r in some_rows(rng, c, rng.randrange(1, 10))]
    # one conversation holds a third of the rows, and lies across partitions; another one is null
    rows += some_rows(rng, 1000, 200) + some_rows(rng, None, 40) + [(2000, 5, "user", "Same.")] * 30 + [(2001, None, "system", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = got(spark.createDataFrame(rows, ROW).repartition(4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert result == expected(rows)


def test_pieces_join_to_the_whole():
    rng = random.Random(8)
    for _ in range(100):
        rows = [(rng.choice([None, 1, 2, 3, 7]), rng.choice("uasoUASOx"), rng.randrange(4)) for _ in range(rng.randrange(60))]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        whole, parts = cv.Piece(1, False), [cv.Piece(1, False) for _ in range(4)]
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(3))
        for i, (turn, code, fault) in enumerate(rows):
            for p in (whole, parts[sum(i >= c for c in cuts)]):
                p.add(turn, code, fault, code.lower(), "")
        assert cv._figures(cv.merged(p.state() for p in parts)) == cv._figures(whole.state())


def test_dropped_and_empty_tables_and_clashing_columns(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Gone."), (5000, 1, "user", "Kept.")]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], ROW + ", cost int, Text string, place int")
    assert got(df) == expected(rows)
    assert got(df)[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.repair_conversations(df.limit(0)).collect() == []


def test_long_texts_and_roles(spark):
    rows = [(1, i, "user" if i % 2 else "a" * 10_000, "wörd " * 100_000 + ".") for i in range(4)]
    assert got(spark.createDataFrame(rows, ROW)) == expected(rows)


def test_sql_agrees_on_odd_rows(spark):
    rng = random.Random(12)
    rows = [r for c in [None, *range(80)] for r in some_rows(rng, c, rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, ROW)
    con = connect("/root/testdata/sf0.001")
    con.register("odd_rows", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT * FROM odd_rows")
    assert difference(cv.repair_conversations(df), con, cv.CONVERSATION_SQL) is None
