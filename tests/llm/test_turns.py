"""Repair of conversations against plain Python: all edits within a budget, best first by (cost, audit)."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curalake.llm.turns import MARK_OF, MARKS, START, STATES, linked, repair_damaged, ways

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows (role, text, fault): least (cost, audit, lines), by a table of the best audit for each row, state and cost."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", [])}

    def inserts(level):
        """At most three in a row are of use: two bring a state back to itself."""
        for _ in range(4):
            for q, (cost, audit, lines) in list(level.items()):
                role = "assistant" if q == 2 else "user"
                new = (cost + 2, audit + "I", [*lines, role + ":"])
                p = step[q][role[0]]
                if p not in level or new < level[p]:
                    level[p] = new
        return level

    inserts(best)
    for role, text, fault in rows:
        after = {}

        def put(q, way):
            if q not in after or way[:2] < after[q][:2]:
                after[q] = way

        for q, (cost, audit, lines) in best.items():
            put(q, (cost + 3, audit + "D", lines))
            if fault in ("", "truncated"):
                also = int(fault == "truncated")
                if role[:1] in step[q]:
                    put(step[q][role[:1]], (cost + also, audit + "K", [*lines, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    if new[0] in step[q]:
                        put(step[q][new[0]], (cost + 2 + also, audit + "R", [*lines, f"{new}:{text}"]))
        best = inserts(after)
    return min((best[q] for q in (0, 3) if q in best), key=lambda w: w[:2])


def brute(table):
    """The contract over rows (conv_id, turn, role, text)."""
    conversations = defaultdict(list)
    for conv, turn, role, text in table:
        own = conversations[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, marked, count = set(), [], defaultdict(int)
        for _, role, text in rows:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = cheapest(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


@given(st.text(alphabet=list(MARKS), max_size=9), st.lists(st.integers(0, 9), max_size=3))
@settings(max_examples=1500, deadline=None)
def test_search_and_links(letters, cuts):
    """One search over all rows, pieces linked anywhere, and the table give the same; so does the audit where ranks of long audits decide."""
    rows = [({"s": "system", "u": "user", "a": "assistant", "": "tool"}[MARKS[m][0]], "x", MARKS[m][1]) for m in letters]
    cost, audit, _ = cheapest(rows)
    (found,) = ways(letters, START, True).values()
    assert found == (cost, audit)
    at = [0, *sorted(min(c, len(letters)) for c in cuts), len(letters)]
    pieces = [{s: ways(letters[a:b], s) for s in STATES} for a, b in itertools.pairwise(at)]
    assert linked(pieces) == (cost, audit)


def test_audits_that_differ_at_the_start():
    """Rows of users only keep two ways open from the first row to the last."""
    letters = MARK_OF["u", ""] * 301
    want = cheapest([("user", "x", "")] * 301)[:2]
    assert ways(letters, START, True) == {3: want}
    assert linked([{s: ways(letters[k : k + 7], s) for s in STATES} for k in range(0, 301, 7)]) == want


TEXTS = ["Hi.", "Hi", "", " \n", None, "What?  ", "é。", "no end", "x ", "!"]
ROLES = ["user", "assistant", "system", None, "", "tool", "Ärger", "same"]
TABLE = [(c, None if (c * 7 + t) % 11 == 0 else t % 6, ROLES[(c + t * t) % (3 if c % 3 else 8)], TEXTS[(c * t + t) % (2 if c % 2 else 10)]) for c in range(60) for t in range(c % 9)]
TABLE += [(None, 3, "user", "Hi."), (None, None, "assistant", None), (77, 0, "user", "x" * 70_000 + "."), (78, 5, None, None), (79, 1, "user", "a."), (79, 1, "user", "a."), (79, 1, "assistant", "b.")]
TABLE += [(500, t, "user" if t % 3 else "assistant", f"text {t % 40}.") for t in range(900)]


@pytest.mark.parametrize("piece", [1024, 7])
def test_query(spark, piece):
    """Nulls, odd roles, repeated rows and turns, a long conversation over many partitions and pieces, extra columns with clashing names."""
    df = spark.createDataFrame(TABLE, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "copies": F.lit("x"), "audit": F.lit(None).cast("int")}).repartition(5)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair_damaged(df, piece).collect()}
    want = brute(TABLE)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv] == row, conv
    assert repair_damaged(df.limit(0)).count() == 0


def test_tables(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    df = spark.read.parquet(path)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair_damaged(df).collect()}
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
