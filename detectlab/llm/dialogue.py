"""Repair of the role structure of conversations by a run-length dynamic program, with an audit of the edits.

A repaired conversation's role initials read ``(s?(ua)+)?``. Edits and what they cost: Keep 0, Rerole to user or assistant 1,
Delete 2 (the only one for a blank or repeated row), Insert a row of empty text, user or assistant, 5; a truncated row that stays
adds 5. Of the cheapest lists of edits the one whose initials are least in ASCII is taken.

Each row is a symbol (its role's initial and its fault), each symbol a min-plus matrix over the four states of the grammar, and a
run of n equal symbols the n-th power of the matrix. Powers of two are kept for each symbol, so the costs from the end
to the start of a conversation take one product for each set bit of each run's length; then the choices are unrolled from the start.

On Spark:

1. Equal rows collapse to one with a count, and rows whose role and text stand at an earlier turn get a mark, by aggregates of digests.
2. Rows and marks are dealt out in ranges of (conversation, turn, digest) and walked in order. A conversation inside one range is
   finished there. One at the edge of a range, or of more than ``PIECE_ROWS`` rows, is cut into pieces, each with the matrix
   of its rows; so no task or row holds a long conversation.
3. A scan of the matrices from the last piece to the first gives each piece the costs behind it; all pieces are unrolled on their
   own from each of the four states; a scan from the first piece to the last picks the state that it begins in.

A digest of a whole conversation is one sequential hash; the last scan makes it and holds one piece at a time (and the audit).

Nulls, ties, empties: a null role or text is one blank, and rows with a null conversation id are a conversation; null turns come
first; rows of one turn stand in the order of the MD5 of role and text; a blank row is no duplicate; a conversation whose rows are all
dropped has zeros, an empty audit and the hash of the empty text; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import materialise

#: Rows and characters of a piece of a conversation.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 23
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States of the grammar: nothing yet, after the system's row, after the user's, after the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: The state after a row of the role that may be put in, and that role's name.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_KINDS = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_FAR = 1 << 40
#: Cost to end the conversation in each state.
_END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]
#: Symbol of a row that must go; others are 1 + 2 * kind + truncated, kind 0 for any other role.
GONE = 0
SYMBOLS = range(9)


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * _KINDS.get(initial, 0) + truncated


def _kept(kind: int, state: int) -> bool:
    """Whether a row of a kind can be kept in a state."""
    return kind and (state == _START if kind == _SYSTEM else _NEXT[state] == kind)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in _STATES) for j in _STATES) for i in _STATES)


def applied(a: Matrix, costs: Vector) -> Vector:
    c0, c1, c2, c3 = costs
    return tuple([min(r[0] + c0, r[1] + c1, r[2] + c2, r[3] + c3) for r in a])


@lru_cache(maxsize=None)
def transition(sign: int) -> Matrix:
    """Costs from state to state of one row, with what is put in before it."""
    kind, truncated = (sign - 1) // 2, (sign - 1) % 2
    rows = []
    for state in _STATES:
        row = [_FAR] * 4
        for inserted, at in ((0, state), (1, _NEXT[state]), (2, _NEXT[_NEXT[state]])):
            cost = INSERT * inserted
            row[at] = min(row[at], cost + DELETE)
            if sign != GONE:
                cost += TRUNCATED * truncated
                row[_NEXT[at]] = min(row[_NEXT[at]], cost + REROLE)
                if _kept(kind, at):
                    row[kind] = min(row[kind], cost)
        rows.append(tuple(row))
    return tuple(rows)


@lru_cache(maxsize=None)
def power(sign: int, exponent: int) -> Matrix:
    """The transition of 2 ** exponent equal rows."""
    return transition(sign) if exponent == 0 else product(power(sign, exponent - 1), power(sign, exponent - 1))


def _bits(n: int) -> Iterator[int]:
    exponent = 0
    while n:
        if n & 1:
            yield exponent
        n, exponent = n >> 1, exponent + 1


@lru_cache(maxsize=1 << 16)
def _before_run(sign: int, n: int, costs: Vector) -> Vector:
    for exponent in _bits(n):
        costs = applied(power(sign, exponent), costs)
    return costs


def before(sign: int, n: int, costs: Vector) -> Vector:
    """Costs to the end before a run of n rows, from those behind it."""
    least = min(costs)
    return tuple([least + c for c in _before_run(sign, n, tuple([c - least for c in costs]))])


def runs(signs: bytes) -> list[tuple[int, int]]:
    return [(sign, sum(1 for _ in same)) for sign, same in groupby(signs)]


def matrix_of(signs: bytes) -> Matrix:
    """The transition of all rows."""
    whole = tuple(tuple(0 if i == j else _FAR for j in _STATES) for i in _STATES)
    for sign, n in runs(signs):
        for exponent in _bits(n):
            whole = product(whole, power(sign, exponent))
    return whole


@lru_cache(maxsize=1 << 16)
def _unroll_run(sign: int, n: int, state: int, behind: Vector) -> tuple[str, int]:
    """The edits of a run that begins in a state, and the state that it ends in. ``behind``: costs after it, their least 0."""
    step = transition(sign)
    costs = [behind]
    for _ in range(n):
        costs.append(applied(step, costs[-1]))
    kind, extra = (sign - 1) // 2, TRUNCATED * ((sign - 1) % 2)
    edits = []
    for left in range(n, 0, -1):
        here, after = costs[left], costs[left - 1]
        while True:
            to_go = here[state]
            if DELETE + after[state] == to_go:
                edits.append("D")
            elif INSERT + here[_NEXT[state]] == to_go:
                edits.append("I")
                state = _NEXT[state]
                continue
            elif _kept(kind, state) and extra + after[kind] == to_go:
                edits.append("K")
                state = kind
            else:
                edits.append("R")
                state = _NEXT[state]
            break
    return "".join(edits), state


def unroll(signs: bytes, state: int, behind: Vector, last: bool) -> tuple[str, int]:
    """The edits of rows that begin in a state, and the state that they end in; ``last`` adds the rows put in at the end."""
    stretches = runs(signs)
    ends = [behind]
    for sign, n in reversed(stretches):
        ends.append(before(sign, n, ends[-1]))
    edits = []
    for (sign, n), costs in zip(stretches, reversed(ends[:-1]), strict=True):
        least = min(costs)
        found, state = _unroll_run(sign, n, state, tuple([c - least for c in costs]))
        edits.append(found)
    while last and _END[state]:
        edits.append("I")
        state = _NEXT[state]
    return "".join(edits), state


def edits_cost(edits: str, signs: bytes) -> int:
    rows = iter(signs)
    cost = 0
    for e in edits:
        if e == "I":
            cost += INSERT
            continue
        sign = next(rows)
        cost += DELETE if e == "D" else (REROLE if e == "R" else 0) + TRUNCATED * ((sign - 1) % 2)
    return cost


def repaired_turns(edits: str, state: int, signs: bytes, roles: list[str], texts: list[str | None]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the rows that there are after the edits."""
    turns, at = [], 0
    for e in edits:
        if e == "K":
            state = (signs[at] - 1) // 2
            turns.append((e, roles[at], texts[at]))
        elif e != "D":
            state = _NEXT[state]
            turns.append((e, _NAMES[state], texts[at] if e == "R" else ""))
        at += e != "I"
    return turns


# --- the walk over ordered rows ---------------------------------------------------------------------------------------

_BLANKS = " \t\n\v\f\r"
_SOLID = re.compile("[^ \t-\r]")
_LEGAL = {"su", "ua", "au"}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Piece:
    """Rows of one conversation in order."""

    def __init__(self, conversation, seq: int, last_initial: str | None, last_turn: int | None):
        #: The number of the piece among those of its conversation in this range.
        self.conversation, self.seq = conversation, seq
        self.signs, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = None
        self.initial, self.turn, self.first_initial = last_initial, last_turn, None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in _LEGAL
        if self.first_initial is None:
            self.first_initial = initial
        self.initial = initial
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.turns += turn != self.turn
            self.turn = turn
        sign = GONE
        if not _SOLID.search(text):
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        else:
            cut = text.rstrip(_BLANKS)[-1] not in ".!?"
            self.truncated += cut
            sign = symbol(initial, cut)
        self.signs.append(sign)
        self.roles.append(role)
        self.texts.append(text if sign else None)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.signs) >= PIECE_ROWS or self.size >= PIECE_CHARS

    def counts(self) -> list[int]:
        return [self.blank, self.duplicate, self.truncated, self.illegal]


def gaps_of(least: int | None, greatest: int | None, turns: int) -> int:
    return 0 if least is None else greatest - least + 1 - turns


def line_digest(digest, turns: list[tuple[str, str, str]], begun: bool) -> bool:
    """Adds ``role:text`` lines to a hash; whether there has been any line."""
    if turns:
        digest.update((("\n" if begun else "") + "\n".join([f"{role}:{text}" for _, role, text in turns])).encode("utf-8"))
    return begun or bool(turns)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Piece, bool]]:
    """Pieces in order, and whether each is a whole conversation that no other range can have a part of."""
    piece, mark, inner = None, None, False
    for batch in batches:
        for conversation, kind, turn, digest, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or conversation != piece.conversation:
                if piece is not None:
                    yield piece, inner and piece.seq == 0
                    inner = True
                piece, mark = Piece(conversation, 0, None, None), None
            if kind == 1:
                mark = turn, digest
            elif kind == 2:
                repeated = mark == (turn, digest)
                for _ in range(n):
                    if piece.full():
                        yield piece, False
                        piece = Piece(conversation, piece.seq + 1, piece.initial, piece.turn)
                    piece.add(turn, role, text, repeated)
                    repeated = True
    if piece is not None:
        yield piece, False


_TURNS = "array<struct<edit:string,role:string,text:string>>"
_WALKED = (
    "slice int, seq long, opens boolean, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    f"repaired_sha256 string, turns {_TURNS}, signs binary, roles array<string>, texts array<string>, matrix array<long>, least long, "
    "greatest long, n_turns long, first_initial string, last_initial string"
)
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _schema(rows: DataFrame, rest: str) -> T.StructType:
    """The conversation id as the table has it, and further fields in DDL."""
    return T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(rest).fields])


def _batches(schema: T.StructType, rows: Iterator[tuple[tuple, int]], at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size, as Arrow batches of limited size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    for row, weight in rows:
        held.append(row)
        size += weight
        if len(held) >= at_once or size >= PIECE_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _walked(ordered: DataFrame, schema: T.StructType, with_turns: bool) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def rows():
            for seq, (piece, whole) in enumerate(_pieces(batches)):
                signs = bytes(piece.signs)
                head = (piece.conversation, number, seq, piece.seq == 0, whole)
                tail = (piece.least, piece.turn, piece.turns, piece.first_initial, piece.initial)
                if not whole:
                    matrix = [c for row in matrix_of(signs) for c in row]
                    yield (*head, None, *piece.counts(), None, None, None, None, signs, piece.roles, piece.texts, matrix, *tail), piece.size
                    continue
                edits, _ = unroll(signs, _START, _END, True)
                turns = repaired_turns(edits, _START, signs, piece.roles, piece.texts)
                digest = hashlib.sha256()
                line_digest(digest, turns, False)
                shown = [dict(zip(("edit", "role", "text"), t, strict=True)) for t in turns] if with_turns else None
                yield (*head, gaps_of(piece.least, piece.turn, piece.turns), *piece.counts(), edits_cost(edits, signs), edits, digest.hexdigest(),
                       shown, None, None, None, None, *tail), piece.size if with_turns else len(edits)

        yield from _batches(schema, rows())

    return materialise(ordered.mapInArrow(walk, schema), "conversations")


def _costs_behind(pieces: DataFrame) -> DataFrame:
    """(slice, seq, behind, last): costs after each piece, by a scan from the last piece of a conversation to its first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, costs = False, _END
        conversation = None
        for batch in batches:
            out = []
            for name, part, seq, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = not known or name != conversation
                if last:
                    known, conversation, costs = True, name, _END
                out.append((part, seq, list(costs), last))
                costs = applied(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), costs)
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["slice", "seq", "behind", "last"])

    dealt = pieces.select("conv_id", "slice", "seq", "matrix").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", F.col("slice").desc(), F.col("seq").desc())
    return ordered.mapInArrow(scan, "slice int, seq long, behind array<long>, last boolean")


@F.arrow_udf(T.StructType([T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def _unrolled(signs: pa.Array, behind: pa.Array, last: pa.Array) -> pa.Array:
    """Edits and last state from each of the four states."""
    audits, ends = [], []
    for s, b, z in zip(signs.to_pylist(), behind.to_pylist(), last.to_pylist(), strict=True):
        found = [unroll(s, state, tuple(b), z) for state in _STATES]
        audits.append([f[0] for f in found])
        ends.append([f[1] for f in found])
    return pa.StructArray.from_arrays([pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["audits", "ends"])


def _finished(pieces: DataFrame, schema: T.StructType, with_turns: bool) -> DataFrame:
    """The report of each conversation in pieces, or its turns, piece by piece."""
    unrolled = pieces.join(_costs_behind(pieces), ["slice", "seq"])
    unrolled = materialise(unrolled.withColumn("u", _unrolled("signs", "behind", "last")).select(
        "conv_id", "slice", "seq", "opens", *_COUNTS, "least", "greatest", "n_turns", "first_initial", "last_initial", "signs", "roles", "texts",
        "u.audits", "u.ends", "last"
    ), "unrolled")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            fresh = True
            for batch in batches:
                for row in batch.to_pylist():
                    if fresh:
                        state, cost, edits, digest, begun = _START, 0, [], hashlib.sha256(), False
                        counts, least, greatest, n_turns, part, initial = [0] * 4, None, None, 0, 0, None
                    found = row["audits"][state]
                    turns = repaired_turns(found, state, row["signs"], row["roles"], row["texts"])
                    if with_turns:
                        yield (row["conv_id"], part, [dict(zip(("edit", "role", "text"), t, strict=True)) for t in turns]), sum(len(t[2]) for t in turns)
                    else:
                        begun = line_digest(digest, turns, begun)
                        edits.append(found)
                        cost += edits_cost(found, row["signs"])
                        counts = [a + row[c] for a, c in zip(counts, _COUNTS, strict=True)]
                        n_turns += row["n_turns"]
                        if row["opens"]:
                            # The walk of a range knows nothing of the range before it.
                            n_turns -= row["least"] is not None and row["least"] == greatest
                            if initial is not None and row["first_initial"] is not None:
                                counts[3] += initial + row["first_initial"] not in _LEGAL
                        least = row["least"] if least is None else least
                        greatest = row["greatest"] if row["greatest"] is not None else greatest
                        initial = row["last_initial"] if row["last_initial"] is not None else initial
                    state, part, fresh = row["ends"][state], part + 1, row["last"]
                    if fresh and not with_turns:
                        audit = "".join(edits)
                        yield (row["conv_id"], gaps_of(least, greatest, n_turns), *counts, cost, audit, digest.hexdigest()), len(audit)

        yield from _batches(schema, rows())

    return unrolled.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq").mapInArrow(scan, schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, kind, turn, digest, role, text, n) in order within ranges. Kind 0: the conversation is there; 1: the row that
    follows stands at an earlier turn, too; 2: n equal rows."""
    there = F.col("copies") > 0
    known = rows.select("conv_id", F.when(there, 2).otherwise(0).alias("kind"), F.when(there, F.col("turn")).alias("turn"),
                        F.when(there, F.col("role")).otherwise("").alias("role"), F.when(there, F.col("text")).otherwise("").alias("text"), "copies")
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    counted = known.groupBy("conv_id", "kind", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    counted = counted.select("conv_id", "kind", "turn", F.when(F.col("kind") == 2, digest).otherwise("").alias("digest"), "role", "text", "n")

    keys = known.where("kind = 2").select("conv_id", "turn", digest.alias("digest"))
    firsts = keys.groupBy("conv_id", "digest").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    firsts = firsts.where((F.col("last") > F.col("first")) | (F.col("unnumbered") & F.col("last").isNotNull()))
    right = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first", "unnumbered")
    later = keys.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    later = later.where(F.col("unnumbered") | (F.col("turn") > F.col("first"))).where("turn IS NOT NULL").select("conv_id", "turn", "digest").distinct()
    marks = later.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"))
    both = counted.unionByName(marks)
    return both.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest", "kind")


def _or_blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows``: conv_id, turn, role, text and copies; a row of no copies only tells that its conversation is there.
    """
    done = _walked(_ordered(rows), _schema(rows, _WALKED), False)
    kind = _schema(rows, ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in _REPORT))
    return done.where("whole").select("conv_id", *_REPORT).union(_finished(done.where("NOT whole"), kind, False))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turns): the repaired rows (edit, role, text) of each conversation, in parts of ``PIECE_ROWS`` rows of it or so."""
    done = _walked(_ordered(rows), _schema(rows, _WALKED), True)
    kind = _schema(rows, f"part long, turns {_TURNS}")
    return done.where("whole").select("conv_id", F.lit(0).cast("long").alias("part"), "turns").union(_finished(done.where("NOT whole"), kind, True))


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A conversation table as ``repair_report`` and ``repaired`` read it."""
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _or_blank(role_col).alias("role"),
                       _or_blank(text_col).alias("text"), F.lit(1).cast("long").alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with faults by the crc32 of ``conv_id:turn`` modulo 20 (nulls: one blank): 0 drops the row,
    1 empties its text, 2 takes out ``.!?``, 3 repeats the row, 4 makes its role user."""
    fault = F.crc32(F.concat(_or_blank("conv_id"), F.lit(":"), _or_blank("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("copies") * F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)).alias("copies"),
    )
