"""Removal of repeated passages with suffix automata.

A window is LENGTH consecutive words of one document. A word is removed if a window over it also starts in a
document with a smaller id.

* Equal documents (by their words) are one: all but the smallest id are removed whole if they have a window.
* Every window has an anchor, the smallest hash of the GRAM-word sequences in it, so equal windows have equal
  anchors. Consecutive windows with one anchor form a segment. Anchors that different documents share are live;
  the text between them is never compared.
* Reference shards are the groups of segments under a live anchor. A shard's documents are streamed in the
  order of ids through the suffix automaton of those before: where the matching statistic, the longest suffix
  read that occurs in the automaton, reaches LENGTH, the words of the match are removed; then the segment
  is added to the automaton. Equal segments are answered without it.
* The automata of all documents together have no size bound, so they are placed with the segments of their
  anchor by a shuffle instead of being broadcast. An anchor with more than HOT segments or HOT_WINDOWS windows is not
  gathered at all: its windows are compared as 128-bit hashes, with a minimum that is aggregated before the shuffle.
  Both ways remove the same words.

Windows are judged on the input, not on what is left after other removals.

Defined results: a null text has no words; documents of fewer than LENGTH words stay whole; documents with the
same id don't remove words from each other, unless their words are equal, when they get the same result; a null
id comes last; very long texts are read whole, and one that repeats a line is one segment; an empty table gives no rows.
Columns other than id and text are not read, so their names may clash with any here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import LAST_ID, id_key, saved, text_bytes

LENGTH = 50
GRAM = 15
#: Most segments of an anchor that are gathered in one task, and most windows that they have together, so that long segments don't fill it.
HOT, HOT_WINDOWS = 2000, 200_000

_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class SuffixAutomaton:
    """The suffix automaton of several word sequences, grown one sequence at a time."""

    def __init__(self) -> None:
        self.after: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        after, link, size = self.after, self.link, self.size
        last = 0
        for w in words:
            to = after[last].get(w)
            if to is not None:
                last = to if size[to] == size[last] + 1 else self._split(last, to, w)
                continue
            new = len(size)
            after.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in after[p]:
                after[p][w] = new
                p = link[p]
            if p >= 0:
                to = after[p][w]
                link[new] = to if size[to] == size[p] + 1 else self._split(p, to, w)
            last = new

    def _split(self, p: int, to: int, w: bytes) -> int:
        """A copy of state `to` for its sequences that end one word after p."""
        new = len(self.size)
        self.after.append(dict(self.after[to]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[to])
        self.link[to] = new
        while p >= 0 and self.after[p].get(w) == to:
            self.after[p][w] = new
            p = self.link[p]
        return new

    def matches(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Where words has sequences of at least `least` words that occur in the automaton: (start, end), in order, merged."""
        after, link, size = self.after, self.link, self.size
        state = n = 0
        out: list[tuple[int, int]] = []
        for j, w in enumerate(words, 1):
            to = after[state].get(w)
            while to is None and state:
                state = link[state]
                n = size[state]
                to = after[state].get(w)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                if out and j - n <= out[-1][1]:
                    out[-1] = (min(out[-1][0], j - n), j)
                else:
                    out.append((j - n, j))
        return out


def segments(words: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and last window of each segment."""
    n = len(words)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = min(GRAM, length)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
    total = np.r_[np.uint64(0), np.cumsum(h * power)]
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - gram, _INVERSE)])
    g = (total[gram:] - total[:-gram]) * back
    g ^= g >> np.uint64(31)
    g *= np.uint64(0x9E3779B97F4A7C15)  # else short words would often be the smallest
    g ^= g >> np.uint64(29)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    if span > width:
        g = np.minimum(g[: -(span - width)], g[span - width :])
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return g[first].view(np.int64), first, np.r_[first[1:], len(g)] - 1


def _digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a word sequence, as two longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8").tolist())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


_RUNS = "h1 long, h2 long, id long, anchor long, first int, last int"


def _anchors(length: int):
    """A row for each document (id set) and for each of its segments (anchor set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                docs, parts = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = text.as_py().split()
                    h = _digest(words)
                    docs.append((*h, key, None, None, None))
                    a, s, e = segments(words, length)
                    parts.append((np.full(len(a), h[0]), np.full(len(a), h[1]), a, s, e))
                yield _batch(docs, _RUNS)
                h1, h2, a, s, e = map(np.concatenate, zip(*parts))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], [c.split()[0] for c in _RUNS.split(", ")])

    return run


#: kind 0: a finished document; 1: the text of a document to finish; 2: a segment; 3: a window of a hot anchor.
_CUT = "kind int, id long, h1 long, h2 long, n_words long, sha string, body binary, anchor long, at int"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text, h1, h2, smallest, runs in zip(*(batch.column(c) for c in ("id", "text", "h1", "h2", "smallest", "runs"))):
                key, text, h1, h2, runs = key.as_py(), text.as_py(), h1.as_py(), h2.as_py(), runs.as_py()
                words = text.split()
                n = len(words)
                if key != smallest.as_py() and n >= length:
                    rows.append((0, key, h1, h2, n, hashlib.sha256(b"").hexdigest(), None, n, None))
                elif not runs:
                    rows.append((0, key, h1, h2, n, hashlib.sha256(b" ".join(words)).hexdigest(), None, 0, None))
                else:
                    rows.append((1, key, h1, h2, n, None, b" ".join(words), None, None))
                    held += len(text)
                    for r in runs:
                        if r["hot"]:
                            for at in range(r["first"], r["last"] + 1):
                                rows.append((3, key, h1, h2, None, None, xxhash.xxh3_128_digest(b" ".join(words[at : at + length])), None, at))
                        else:
                            body = b" ".join(words[r["first"] : r["last"] + length])
                            held += len(body)
                            rows.append((2, key, h1, h2, None, None, body, r["anchor"], r["first"]))
                if held > 8_000_000 or len(rows) > 50_000:
                    yield _batch(rows, _CUT)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _CUT)

    return run


_SPANS = "id long, h1 long, h2 long, start int, stop int"


def _shards(length: int):
    """Spans to remove, from segments sorted by anchor and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen, unbuilt, automaton = None, {}, [], None
        for batch in batches:
            rows: list[tuple] = []
            for a, key, h1, h2, at, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "h1", "h2", "at", "body"))):
                if a != anchor:
                    anchor, seen, unbuilt, automaton = a, {}, [], None
                before = seen.get(body)
                if before is not None and before < key:
                    rows.append((key, h1, h2, at, at + body.count(b" ") + 1))
                    continue
                words = body.split(b" ")
                while unbuilt and unbuilt[0][0] < key:
                    automaton = automaton or SuffixAutomaton()
                    automaton.add(unbuilt.pop(0)[1])
                if automaton is not None:
                    rows += [(key, h1, h2, at + s, at + e) for s, e in automaton.matches(words, length)]
                if before is None:
                    seen[body] = key
                    unbuilt.append((key, words))
            if rows:
                yield _batch(rows, _SPANS)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary"


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, body, spans in zip(*(batch.column(c) for c in ("id", "n_words", "body", "spans"))):
                words = body.as_py().split(b" ")
                gone = np.zeros(len(words) + 1, np.int32)
                for s in spans.as_py() or ():
                    gone[s["start"]] += 1
                    gone[s["stop"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((key.as_py(), n.as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                yield _batch(rows, _OUT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for)."""
    keyed = docs.select(id_key(id_col).alias("id"), text_bytes(text_col).alias("text"))
    table = saved(keyed.mapInArrow(_anchors(length), _RUNS), "runs")
    firsts = table.where("anchor is null").groupBy("h1", "h2").agg(F.min("id").alias("smallest"))
    runs = table.where("anchor is not null").select("h1", "h2", "anchor", "first", "last")
    live = runs.groupBy("anchor").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + 1).alias("windows")).where("low < high")
    live = live.select("anchor", ((F.col("n") > hot) | (F.col("windows") > hot * (HOT_WINDOWS // HOT))).alias("hot"))
    lists = runs.join(live, "anchor").groupBy("h1", "h2").agg(F.collect_set(F.struct("anchor", "first", "last", "hot")).alias("runs"))
    plan = firsts.join(lists, ["h1", "h2"], "left")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([_digest(x.as_py().split()) for x in batch.column(1)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h[:, 0]), pa.array(h[:, 1])], ["id", "text", "h1", "h2"])

    placed = keyed.mapInArrow(signed, "id long, text binary, h1 long, h2 long").join(plan, ["h1", "h2"])
    cut = saved(placed.select("id", "text", "h1", "h2", "smallest", "runs").mapInArrow(_cut(length), _CUT), "cut")
    shards = cut.where("kind = 2").select("anchor", "id", "h1", "h2", "at", "body").repartition("anchor").sortWithinPartitions("anchor", "id", "h1", "h2", "at")
    spans = shards.mapInArrow(_shards(length), _SPANS)
    windows = cut.where("kind = 3").select("id", "h1", "h2", "body", "at")
    smallest = windows.groupBy("body").agg(F.min("id").alias("smallest"))
    spans = spans.unionByName(windows.join(smallest, "body").where("smallest < id").select("id", "h1", "h2", F.col("at").alias("start"), (F.col("at") + length).cast("int").alias("stop")))
    gone = spans.groupBy("id", "h1", "h2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    open_docs = cut.where("kind = 1").select("id", "h1", "h2", "n_words", "body").join(gone, ["id", "h1", "h2"], "left")
    finished = cut.where("kind = 0").select("id", "n_words", F.col("anchor").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    out = open_docs.select("id", "n_words", "body", "spans").mapInArrow(_remove(with_text), _OUT)
    null = F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")).alias("doc_id")
    out = out.unionByName(finished.withColumnRenamed("id", "doc_id").withColumn("kept_text", F.lit(None).cast("binary")))
    return out.select(null, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
