"""Conversation repair against a search over all edits, row by row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from detectlab.llm import dialogue
from detectlab.llm.queries import QUERIES
from detectlab.session import read_table

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def best_edits(faults):
    """(cost, audit, lines) of the cheapest repair: all edits of all prefixes, kept by what the grammar can tell apart."""
    def state_of(initials):
        return initials[-1:] if initials != "s" else "s"

    # (last initial) -> (cost, audit, lines)
    best = {"": (0, "", ())}

    def better(new, key, value):
        if key not in new or value[:2] < new[key][:2]:
            new[key] = value

    def with_inserts(known):
        for _ in range(4):
            new = dict(known)
            for key, (cost, audit, lines) in known.items():
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[key]
                better(new, role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
            known = new
        return known

    for role, text, fault in faults:
        new = {}
        for key, (cost, audit, lines) in with_inserts(best).items():
            better(new, key, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[key]
            if role[:1] and role[:1] in allowed:
                better(new, role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if name[0] in allowed:
                    better(new, name[0], (cost + extra + 1, audit + "R", (*lines, f"{name}:{text}")))
        best = new
    ends = with_inserts(best)
    return min(v for k, v in ends.items() if k in ("", "a"))


def brute(rows, damaged=None):
    damaged = damage(rows) if damaged is None else damaged
    by_conv = defaultdict(list)
    for r in damaged:
        by_conv[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(by_conv[conv], key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            fault = None
            if not SOLID.search(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(" \t\n\v\f\r")[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda name: sum(f == name for _, _, f in faults)  # noqa: E731,B023
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = best_edits(faults)
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def report(df):
    rows = [tuple(r) for r in df.select("conv_id", *dialogue._REPORT).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def compare(got, want):
    assert got == {k: v[:-1] for k, v in want.items()}


def test_conversations(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    compare(report(QUERIES["op11_conversation_repair"](spark, sf)), brute(rows))


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6, 7, *range(100, 160)])
        turn = rng.choice([None, *range(30 if conv != 1 else 2000)])
        role = rng.choice([None, "system", "user", "user", "user", "assistant", "assistant", "tool", ""])
        text = rng.choice([None, "", " \t", "Yes.", "No!", "cut off", f"Text {rng.random()}?", f"text {rng.random()}", "é. ", "x" * 50])
        rows.append((conv, turn, role, text))
    rows += [(200, 5, "user", "same.")] * 40 + [(201, None, "user", "same.")] * 3 + [(201, 7, "user", "same.")]
    return rows


@pytest.mark.parametrize(("rows_a_piece", "partitions"), [(4096, 2), (3, 16)])
def test_pieces_and_ranges(spark, monkeypatch, rows_a_piece, partitions):
    monkeypatch.setattr(dialogue, "PIECE_ROWS", rows_a_piece)
    rows = odd_rows(partitions)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("kind", "n", "digest", "seq", "copies", "__fault")])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = dialogue.conversations(df)
        want = brute(rows)
        compare(report(dialogue.repair_report(dialogue.damaged(turns))), want)
        compare(report(dialogue.repair_report(turns)), brute(rows, [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]))
        lines = defaultdict(list)
        for r in sorted(dialogue.repaired(dialogue.damaged(turns)).collect(), key=lambda r: r.part):
            lines[r.conv_id] += [f"{t.role}:{t.text}" for t in r.turns]
        assert {k: tuple(v) for k, v in lines.items()} == {k: v[-1] for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert report(dialogue.repair_report(dialogue.damaged(dialogue.conversations(empty)))) == {}


def test_powers_equal_repeated_steps():
    rng = random.Random(1)
    for sign in dialogue.SYMBOLS:
        for n in (1, 2, 3, 7, 12):
            costs = tuple(rng.randrange(12) for _ in range(4))
            stepped = costs
            for _ in range(n):
                stepped = dialogue.applied(dialogue.transition(sign), stepped)
            assert dialogue.before(sign, n, costs) == stepped
            assert dialogue.applied(dialogue.matrix_of(bytes([sign]) * n), costs) == stepped


def test_long_runs():
    signs = bytes([dialogue.symbol("u", False)]) * 3000 + bytes([dialogue.GONE]) * 3000
    edits, state = dialogue.unroll(signs, 0, dialogue._END, True)
    assert edits == "KR" * 1500 + "D" * 3000 and state == 3 and dialogue.edits_cost(edits, signs) == 1500 + 6000
