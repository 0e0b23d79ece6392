"""Repair of the turn structure of conversations: the cheapest edits that give system? (user assistant)+, or nothing.

The rows of a conversation and the states of the grammar form a lattice. From (rows read, state) an edit leads on: keep or
rerole the next row, delete it, or insert an empty one. Dijkstra's search runs on this lattice without building it; its
priority is (cost, audit), the audit being the initials of the edits so far, and it stops at the first node that is popped
with all rows read in an accepting state. Of edits with equal cost the audit that is least in ASCII wins: two audits that
reach one node at one cost differ at some place, so what follows can't change their order.

Conversations may be of any length. Rows are range-partitioned in their order, which spreads a long conversation over
tasks, and are cut into pieces of at most PIECE rows. A piece that is a whole conversation is searched to its end. For any other,
the search gives the cheapest way from each state before it to each state behind it, and the pieces of a conversation are then
linked in order. Audits are compared there by a rank and a short rest, so that linking takes time in proportion to the pieces.

Only marks of rows (order, digest, fault) travel in these steps. Texts are shuffled once, by conversation, behind a row with
the audit, and stream through the hash of the repaired conversation. A hash of a whole conversation takes its rows one after
the other, so they pass through one task, in bounded memory.

Defined results: a null conv_id, turn, role or text counts as one space wherever text is made of it; a null conv_id is a
conversation of its own, returned as null; rows of one turn are in the order of role, then of the digest of their text;
repeated rows are duplicates; a role without letters is no role of the grammar, so its row is reroled or deleted; empty and
white texts are blank; very long texts are hashed as a stream; a conversation without rows has the empty audit and the hash of the
empty text; an empty table gives no rows. Columns other than the four are not read, so their names may clash with any here.
An audit is one value of a row, so a conversation may have 2^31 edits at most.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import PLAIN, discard, give_back, saved

#: States: at the start, after system, after user, after assistant. From each state, the state that an initial leads to.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ACCEPTING, STATES = 0, (0, 3), range(4)
#: The role that rerole and insert give in each state, and the state that it leads to.
GIVEN = ("user", "user", "assistant", "user")
LEADS = tuple(step[role[0]] for step, role in zip(STEPS, GIVEN))
#: Costs of edits, and of a truncated row that isn't deleted.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Pairs of initials of rows next to each other that are right.
PAIRS = {"su", "ua", "au"}
#: Rows of a piece.
PIECE = 1024

SPACE = " \t\n\x0b\x0c\r"
#: A row in a piece is one letter: its initial, and a mark of its fault. MARKS gives them back.
FAULTS = ("", "truncated", "duplicate", "blank")
_LETTERS = "abcdefghijklmnop"
MARKS = {letter: (initial, fault) for letter, (initial, fault) in zip(_LETTERS, ((i, f) for i in ("s", "u", "a", "") for f in FAULTS))}
MARK_OF = {mark: letter for letter, mark in MARKS.items()}


def ways(marks: str, start: int, whole: bool = False) -> dict[int, tuple[int, str]]:
    """Dijkstra from (0, start): for each state behind all rows its cost and audit; if whole, for the first accepting one only."""
    n, rows = len(marks), [MARKS[m] for m in marks]
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    settled: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str]] = {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == n:
            if not whole:
                ends[state] = (cost, audit)
            elif state in ACCEPTING:
                return {state: (cost, audit)}
        else:
            initial, fault = rows[at]
            heapq.heappush(queue, (cost + DELETE, audit + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                also = TRUNCATED if fault else 0
                heapq.heappush(queue, (cost + REROLE + also, audit + "R", at + 1, LEADS[state]))
                if initial in STEPS[state]:
                    heapq.heappush(queue, (cost + also, audit + "K", at + 1, STEPS[state][initial]))
        heapq.heappush(queue, (cost + INSERT, audit + "I", at, LEADS[state]))
    return ends


def linked(pieces: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the ways through its pieces, from each state before a piece to each behind it.

    A way so far has a cost and (rank, rest): audits with a smaller rank are smaller, those of one rank are equal up to their rests.
    """
    front = {START: (0, 0, "")}
    back: list[dict[int, int]] = []
    for piece in pieces:
        best: dict[int, tuple[int, int, str, int]] = {}
        for before, (cost, rank, rest) in front.items():
            for state, (more, audit) in piece[before].items():
                way = (cost + more, rank, rest + audit, before)
                if state not in best or way < best[state]:
                    best[state] = way
        back.append({state: way[3] for state, way in best.items()})
        ranks: dict[tuple[int, str], tuple[int, str]] = {}
        base: tuple[int, str] | None = None
        for key in sorted({way[1:3] for way in best.values()}):
            if base is None or key[0] != base[0] or not key[1].startswith(base[1]):
                base, rank = key, len(ranks)
            ranks[key] = (rank, key[1][len(base[1]) :])
        front = {state: (way[0], *ranks[way[1:3]]) for state, way in best.items()}
    cost, *_, state = min((*front[s], s) for s in ACCEPTING if s in front)
    parts = []
    for piece, before in zip(reversed(pieces), reversed(back)):
        parts.append(piece[before[state]][state][1])
        state = before[state]
    return cost, "".join(reversed(parts))


def repaired(rows: Iterator[tuple[bytes, bytes]], audit: str) -> Iterator[bytes]:
    """The lines of the repaired conversation; rows are (role, text) in order."""
    state = START
    for edit in audit:
        if edit == "I":
            yield GIVEN[state].encode() + b":"
            state = LEADS[state]
            continue
        role, text = next(rows)
        if edit == "K":
            yield role + b":" + text
            state = STEPS[state][role[:1].decode()]
        elif edit == "R":
            yield GIVEN[state].encode() + b":" + text
            state = LEADS[state]


def _given(name: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv, turn, role, text and copies: how often the row is there after damage (0, 1 or 2)."""
    kind = F.crc32(F.concat(_given("conv_id"), F.lit(":"), _given("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), _given("role").alias("role"), _given("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


#: The order of rows in a conversation: a null turn is first.
_ORDER = ("conv", "turn", "role", "digest")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, copies) with digest, which tells role and text."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))


def marks(rows: DataFrame) -> DataFrame:
    """Rows as marks: conv, turn, role, digest, n (equal rows), and first: how many of them aren't duplicates (0 or 1), with initial and fault.

    Equal rows are counted first; the first of a digest is found by a minimum over these counts. Both are partial aggregations.
    """
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(seen == "", "blank").when(F.substring(seen, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("")
    there = _ordered(rows.where("copies > 0")).select("conv", "turn", "role", "digest", "copies", initial.alias("initial"), fault.alias("fault"))
    counted = saved(there.groupBy("conv", "turn", "role", "digest", "initial", "fault").agg(F.sum("copies").alias("n")), "marks", **PLAIN)
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(turn).alias("at"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    out = counted.join(first, same).withColumn("first", turn.eqNullSafe(F.col("at")).cast("long")).drop("c", "d", "at")
    out.counted = counted
    return out


_PIECE = "conv long, part int, at long, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, left string, right string, ways array<struct<before:int,state:int,cost:long,audit:string>>"


def _pieces(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted marks as pieces. A piece that begins or ends its partition may be a part of a conversation, and is given ways from all states."""
    part, out = TaskContext.get().partitionId(), []

    def runs() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault", "n", "first")]
            yield from zip(*columns)

    def closed(piece: dict, whole: bool) -> dict:
        letters = "".join(piece.pop("marks"))
        found = {START: ways(letters, START, True)} if whole else {s: ways(letters, s) for s in STATES}
        piece["whole"] = whole
        piece["ways"] = [{"before": b, "state": s, "cost": c, "audit": a} for b, ends in found.items() for s, (c, a) in ends.items()]
        return piece

    def opened(conv: int | None, at: int) -> dict:
        return {"conv": conv, "part": part, "at": at, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "turns": 0, "left": None, "right": None, "marks": []}

    piece: dict | None = None
    at, alone = 0, False  # alone: no piece of this conversation can be elsewhere, if it ends here
    for conv, turn, initial, fault, n, first in runs():
        if piece is not None and conv != piece["conv"]:
            out.append(closed(piece, alone))
            at, alone, piece = at + 1, True, None
        for k in range(n):
            if piece is not None and len(piece["marks"]) == size:
                out.append(closed(piece, False))
                at, alone, piece = at + 1, False, None
            if piece is None:
                piece = opened(conv, at)
            own = fault if fault == "blank" or k < first else "duplicate"
            if own:
                piece[own] += 1
            if turn is not None and turn != piece["high"]:
                piece["turns"] += 1
                piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["high"] = turn
            if piece["marks"]:
                piece["illegal"] += piece["right"] + initial not in PAIRS
            else:
                piece["left"] = initial
            piece["right"] = initial
            piece["marks"].append(MARK_OF[initial, own])
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, _ARROW)
            out = []
    if piece is not None:
        out.append(closed(piece, False))
    yield pa.RecordBatch.from_pylist(out, _ARROW)
    give_back()


_WAY = pa.struct([("before", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_LONGS = ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")
_ARROW = pa.schema(
    [("conv", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in _LONGS), ("left", pa.string()), ("right", pa.string()), ("ways", pa.list_(_WAY))]
)

_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "conv long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", audit string"
_PLAN_ARROW = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("audit", pa.string())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of conversation and place, as the plan of each conversation."""
    out: list[dict] = []
    pieces: list[dict] = []

    def closed() -> dict:
        found = []
        for p in pieces:
            table: dict[int, dict[int, tuple[int, str]]] = {}
            for way in p["ways"]:
                table.setdefault(way["before"], {})[way["state"]] = (way["cost"], way["audit"])
            found.append(table)
        plan = {"conv": pieces[0]["conv"]} | {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
        plan["cost"], plan["audit"] = linked(found)
        plan["illegal"] += sum(a["right"] + b["left"] not in PAIRS for a, b in zip(pieces, pieces[1:]))
        timed = [p for p in pieces if p["turns"]]
        turns = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        plan["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
        return plan

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for piece in batch.slice(at, 64).to_pylist():
                if pieces and piece["conv"] != pieces[0]["conv"]:
                    out.append(closed())
                    pieces = []
                pieces.append(piece)
        yield pa.RecordBatch.from_pylist(out, _PLAN_ARROW)
        out = []
    if pieces:
        yield pa.RecordBatch.from_pylist([closed()], _PLAN_ARROW)
    give_back()


def plans(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """One row per conversation that has rows (conv, turn, role, text, copies): its faults, and the cost and audit of its repair."""
    found = marks(rows)
    pieces = saved(found.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(partial(_pieces, size), _PIECE), "pieces")
    discard(found.counted)
    # A whole conversation is one piece; there are no others but for those that pieces of a partition's edge, or many pieces, belong to.
    way = F.element_at("ways", 1)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(F.lit(0).cast("long"))
    single = pieces.where("whole").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", way["cost"].alias("cost"), way["audit"].alias("audit"))
    several = pieces.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(_linked, _PLAN)
    out = single.unionByName(several)
    out.pieces = pieces
    return out


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation behind the row with its plan, as its result."""
    names = ("kind", "conv", "role", "text", "copies", *_FIGURES, "audit")
    nothing = dict.fromkeys(_FIGURES, 0) | {"audit": ""}
    done: list[dict] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            texts = columns[3].cast(pa.binary())
            for k, head in enumerate(zip(*(columns[c].to_pylist() for c in (0, 1, 4)))):
                yield *head, columns, k, texts

    stream = rows()
    row = next(stream, None)
    while row is not None:
        kind, conv, _, columns, k, _ = row
        plan = {c: columns[names.index(c)][k].as_py() for c in nothing} if kind == 0 else nothing
        if kind == 0:
            row = next(stream, None)

        def own() -> Iterator[tuple[bytes, bytes]]:
            nonlocal row
            while row is not None and row[1] == conv and row[0] == 1:
                _, _, copies, columns, k, texts = row
                if copies:
                    pair = columns[2][k].as_py().encode(), texts[k].as_py()
                    for _ in range(copies):
                        yield pair
                row = next(stream, None)

        lines, digest, between = own(), hashlib.sha256(), b""
        for line in repaired(lines, plan["audit"]):
            digest.update(between + line)
            between = b"\n"
        for _ in lines:  # rows behind the last edit have no copies
            pass
        done.append({"conv_id": conv, **plan, "repaired_sha256": digest.hexdigest()})
        if len(done) >= 1024:
            yield pa.RecordBatch.from_pylist(done, _RESULT)
            done = []
    yield pa.RecordBatch.from_pylist(done, _RESULT)
    give_back()


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """One row per conversation of rows (conv, turn, role, text, copies): conv_id, its faults, cost, audit and the hash of its repaired lines."""
    planned = plans(rows, size)
    heads = saved(planned, "plans")
    discard(planned.pieces)
    nothing = [F.lit(None).cast("long").alias(c) for c in _FIGURES] + [F.lit(None).cast("string").alias("audit")]
    text = F.when(F.col("copies") > 0, F.col("text"))
    tail = _ordered(rows).select(F.lit(1).alias("kind"), "conv", "turn", "role", "digest", text.alias("text"), "copies", *nothing)
    blanks = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))]
    head = heads.select(F.lit(0).alias("kind"), "conv", *blanks, *_FIGURES, "audit")
    both = head.unionByName(tail).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").drop("turn", "digest")
    return both.mapInArrow(_repaired, "conv_id long, " + ", ".join(f"{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """The repair of every conversation after damage; one row for each conv_id. size: rows of a piece."""
    return repair(damaged(conversations), size)
