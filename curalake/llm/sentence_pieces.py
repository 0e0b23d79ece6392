"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces never have a white-space mark after another character, merging can't cross from a character to
the mark behind it. A text is cut there, into chunks: marks and what follows them up to the next mark. A chunk is
segmented the same wherever it stands, so each task keeps a table of the distinct chunks that it has met, with their
ids and labels. Texts are cut into chunks a block at a time; the distinct chunks of a block are looked up, new ones are
segmented together, once each, and what the table has of them is taken back by position and joined for each text. The table
has a fixed bound; a chunk that was dropped is segmented again. Decoding emits the labels of ids: pieces with marks as
spaces, byte pieces as bytes.

Texts are independent of each other, so documents are encoded in parallel with no shuffle.

Defined results: null texts count as empty; an empty text has the end id only, and decodes to the empty text; the mark
itself in a text is a space to the model; very long texts are read in blocks of chunks, so that memory doesn't grow with
the number of words (a word without white space is one chunk, however long); equal rows get equal results, one row each; an
empty table gives no rows. Columns other than id and text are not read, so their names may clash with any here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import give_back

#: Stands for white space in pieces.
MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: The last character of a chunk.
_LAST = re.compile(f"[^ {MARK}](?=[ {MARK}])")
#: Letters that are cut into chunks at a time.
BLOCK = 1 << 22


def blocks(text: str) -> Iterator[str]:
    """A text behind its leading mark, in blocks of at least BLOCK letters that end where chunks end."""
    text = " " + text
    at = 0
    while len(text) - at > 2 * BLOCK:
        last = _LAST.search(text, at + BLOCK)
        if last is None:
            break
        yield text[at : last.end()]
        at = last.end()
    yield text[at:]


def chunk_lists(parts: list[str]) -> pa.ListArray:
    """The chunks of each block, by a separator that no block has."""
    joined = pa.array(parts, pa.string())
    separators = (c for c in map(chr, range(0xFDD0, 0xFDF0)) if not any(c in p for p in parts))  # characters that texts aren't meant to hold
    separator = next(separators, None)
    if separator is None:
        return pa.array([_CHUNK.findall(p) for p in parts], pa.list_(pa.string()))
    return pc.split_pattern(pc.replace_substring_regex(joined, f"([^ {MARK}])([ {MARK}])", f"\\1{separator}\\2"), separator)


class ChunkTable:
    """Distinct chunks with their ids, for a model file."""

    #: Chunks of the table, letters of their texts, and letters of the longest chunk that is kept.
    ROWS, LETTERS, LONGEST = 400_000, 1 << 24, 1 << 10

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = list(map(self.model.id_to_piece, range(size)))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces across white space")
        if self.model.encode(f"  a{MARK} ") != self.model.encode("  a  ") or self.model.decode(self.model.encode("  a  ")) != "  a  ":
            raise ValueError("the model changes white space before it cuts a text")
        self.labels: list[bytes] = []
        for i, piece in enumerate(pieces):
            if self.model.is_byte(i):
                self.labels.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i):
                self.labels.append(b"")
            elif self.model.is_unknown(i):
                self.labels.append(" \u2047 ".encode())
            else:
                self.labels.append(piece.replace(MARK, " ").encode())
        self.marked = {i for i, p in enumerate(pieces) if p.startswith(MARK)}
        self.alone = [self.model.piece_to_id(MARK)]  # of a mark at the end of a text
        self.table: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.letters = 0

    def row(self, chunk: str, ids: list[int]) -> tuple:
        """What the table keeps of a chunk."""
        return tuple(ids)

    def rows(self, found: list[str]) -> list[tuple]:
        """The rows of distinct chunks. The table keeps those that aren't too long, and the rows of the turn before for one more turn."""
        table, old = self.table, self.old
        out = list(map(table.get, found))
        gone = [at for at, row in enumerate(out) if row is None]
        new = [at for at in gone if found[at] not in old]
        segments = self.model.encode([found[at][1:] for at in new], num_threads=1)  # the model adds the first mark
        fresh = dict(zip(new, segments))
        if len(table) > self.ROWS or self.letters > self.LETTERS:
            self.old, self.table, self.letters = table, {}, 0
        for at in gone:
            chunk = found[at]
            out[at] = row = self.row(chunk, fresh[at] if len(chunk) > 1 else self.alone) if at in fresh else old[chunk]
            if len(chunk) <= self.LONGEST:
                self.table[chunk] = row
                self.letters += len(chunk)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for block in blocks(text) if text else ():
            found = _CHUNK.findall(block)
            distinct = list(dict.fromkeys(found))
            rows = dict(zip(distinct, self.rows(distinct)))
            out += chain.from_iterable(map(rows.__getitem__, found))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no character give the replacement character."""
        text = b"".join(map(self.labels.__getitem__, ids))
        first = next((i for i in ids if self.labels[i]), None)
        return (text[1:] if first in self.marked else text).decode(errors="replace")


class DigestTable(ChunkTable):
    """The table with what digests need of a chunk: the number of its ids, the ids in decimals, the label."""

    def row(self, chunk: str, ids: list[int]) -> tuple[int, str, str | bytes]:
        label = b"".join(map(self.labels.__getitem__, ids))
        return len(ids), " ".join(map(str, ids)), chunk if label == chunk.encode() else label

    def joined(self, parts: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """For each block the number of its ids, the ids in decimals and the labels."""
        lists = chunk_lists(parts)
        coded = lists.flatten().dictionary_encode()
        n, ids, labels = zip(*self.rows(coded.dictionary.to_pylist()))
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.r_[0, np.cumsum(np.fromiter(n, np.int64, len(n))[coded.indices.to_numpy()])]
        back = [pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(column, pa.binary()).take(coded.indices)), between) for column, between in ((ids, b" "), (labels, b""))]
        return counts[ends[1:]] - counts[ends[:-1]], back[0].to_pylist(), back[1].to_pylist()

    def digests(self, texts: list[str], end_id: int) -> list[tuple[int, str, str]]:
        """For each text the number of ids with the end id, SHA-256 of the ids in decimals, SHA-256 of the decoded text."""
        counts = [1] * len(texts)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        last = -1  # the text whose mark was removed
        waiting: list[tuple[int, str]] = []
        letters = 0
        parts = ((at, block) for at, text in enumerate(texts) if text for block in blocks(text))
        for part in chain(parts, [None]):
            if waiting and (part is None or letters > BLOCK):
                for (at, _), n, ids, label in zip(waiting, *self.joined([block for _, block in waiting])):
                    counts[at] += int(n)
                    hashes[at][0].update(ids + b" ")
                    hashes[at][1].update(label if at == last else label.removeprefix(b" "))
                    last = at
                waiting, letters = [], 0
            if part is not None:
                waiting.append(part)
                letters += len(part[1])
        for ids, _ in hashes:
            ids.update(str(end_id).encode())
        return [(n, ids.hexdigest(), text.hexdigest()) for n, (ids, text) in zip(counts, hashes)]


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """Loaded once in each Python worker."""
    return ChunkTable(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with a column of token ids and the end id; the new column replaces one of the same name."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        t = chunk_table(path)
        end = [t.model.eos_id()]
        return texts.map(lambda x: t.encode(x or "") + end)

    return docs.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        t = chunk_table(path)
        return ids.map(lambda x: None if x is None else t.decode(x))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens (with the end id), ids_sha256, decoded_sha256. Encodes and decodes in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = DigestTable(path)  # loaded for the task, and gone with it
        end = t.model.eos_id()
        for batch in batches:
            rows = t.digests([text or "" for text in batch.column(1).to_pylist()], end)
            columns = zip(*rows) if rows else ([], [], [])
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del t
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
