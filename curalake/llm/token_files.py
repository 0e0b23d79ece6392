"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by id; each partition becomes one shard: an Arrow IPC file (the stream
format with a footer) whose batches hold two fixed-size lists of `length` values, the ids and a mask that
is false on the padding behind the last id of the shard. Lists of fixed size have no offsets, so sequence i
lies at i * length of the batch's buffer and is read from the mapped file without a copy. A second file
lists the documents of the shard: id, first id, number of ids. Ids are 16 bits wide if the vocabulary
allows it. A shard is written under a name of the task attempt and then renamed, so that a task that runs
twice leaves one whole file.

A document's pieces between white space are looked up in a memo of fixed size in each Python worker; the
pre-tokenizer and the model of the tokenizers library encode the pieces that are not there.

Defined results: a null text counts as empty and has the end id alone; documents with the same id follow
each other in the order of a hash of the text; null ids come last. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalake.llm.bpe import _RARE, byte_letters
from curalake.llm.common import LAST_ID, Memo, id_key, shared_path, text_bytes

LENGTH = 2048
#: Sequences in a batch.
ROWS = 64
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where byte-level BPE always splits: before a word with the one space before it, and inside longer white space.
_PIECE = re.compile(rf" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")

#: A word with signs behind it, none of which begins a contraction.
_SIGNS_AFTER = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class PieceEncoder:
    """Texts to the bytes of their ids."""

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.code, self.dtype = ("I", np.dtype("<u4")) if self.wide else ("H", np.dtype("<u2"))
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.merge = self.tokenizer.model.tokenize
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        self.memo = Memo(self._piece, limit)

    def _piece(self, piece: str) -> bytes:
        """Letters, and letters before signs, are split as the pre-tokenizer would; it splits all others itself. The library merges each part."""
        word = piece[1:] if piece[0] == " " else piece
        if _RARE.search(piece):
            parts = self.split(piece)
            return self._merged(parts[0][0]) if len(parts) == 1 else b"".join([self.memo[piece[i:j]] for _, (i, j) in parts])
        if word.isalpha():
            return self._merged("".join(map(self.letters.__getitem__, piece.encode())))
        ends = _SIGNS_AFTER.fullmatch(piece)
        if ends and ends[1].strip(" ").isalpha():
            return self.memo[ends[1]] + self.memo[ends[2]]
        parts = self.split(piece)
        if len(parts) == 1:
            return self._merged(parts[0][0])
        return b"".join([self.memo[piece[i:j]] for _, (i, j) in parts])

    def _merged(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def ids(self, text: str) -> bytes:
        if self.marks is not None and self.marks.search(text):  # these split a text before its white space does
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class ShardWriter:
    """One shard: ids are packed one after the other into sequences."""

    def __init__(self, folder: str, shard: int, attempt: int, dtype: np.dtype, length: int = LENGTH):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.names = {kind: (f"{base}/.{kind}-{shard:06d}-{attempt}", f"{base}/{kind}-{shard:06d}.arrow") for kind in ("ids", "docs")}
        self.length, self.dtype = length, dtype
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = {kind: self.fs.open_output_stream(a) for kind, (a, _) in self.names.items()}
        self.out = pa.ipc.new_file(self.sinks["ids"], self.schema)
        self.docs_out = pa.ipc.new_file(self.sinks["docs"], self.docs_schema)
        self.held, self.n_held, self.n, self.docs = [], 0, 0, []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n, n))
        self.n += n
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= ROWS * self.length:
            self._flush()
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self, last: bool = False) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        block = ROWS * self.length
        whole = len(flat) // block * block
        for at in range(0, whole, block):
            self._write(flat[at : at + block], block)
        rest = flat[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.tobytes()], len(rest)

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(flat)) < n)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def _flush_docs(self) -> None:
        if self.docs:
            self.docs_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs)], schema=self.docs_schema))
            self.docs = []

    def close(self) -> int:
        self._flush(last=True)
        self._flush_docs()
        self.out.close()
        self.docs_out.close()
        for kind, (a, b) in self.names.items():
            self.sinks[kind].close()
            self.fs.move(a, b)
        return self.n


class ShardReader:
    """Random access to a shard."""

    def __init__(self, folder: str, shard: int):
        fs, base = _open(folder)
        names = [f"{base}/{kind}-{shard:06d}.arrow" for kind in ("ids", "docs")]
        sources = [pa.memory_map(n) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(n) for n in names]
        self.file, self.docs = map(pa.ipc.open_file, sources)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view of the file."""
        k, r = divmod(i, ROWS)
        mask = self.file.get_batch(k).column(1)[r].as_py()
        return self._batch(k)[r * self.length : (r + 1) * self.length], np.array(mask)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids from start; a view if they lie in one batch."""
        block = ROWS * self.length
        parts = []
        while n:
            k, r = divmod(start, block)
            part = self._batch(k)[r : r + n]
            parts.append(part)
            start += len(part)
            n -= len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Encode docs and write the shards; gives (shard, documents, ids) for each shard, in the order of ids."""
    keyed = docs.select(id_key(id_col).alias("id"), text_bytes(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = keyed.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, n_docs = encoder(path), None, 0
        end = array(e.code, [end_id]).tobytes()
        task = TaskContext.get()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    out = ShardWriter(folder, task.partitionId(), task.taskAttemptId(), e.dtype, length)
                out.add(key, e.ids(text.as_py().decode()) + end)
                n_docs += 1
        if out is not None:
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "docs": [n_docs], "ids": [out.close()]})

    rows = placed.mapInArrow(write, "shard long, docs long, ids long").collect()  # a row for each shard
    return sorted(map(tuple, rows))


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    numbers = [s for s, _, _ in shards]
    bases = np.concatenate([[0], np.cumsum([n for _, _, n in shards])]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = ShardReader(folder, numbers[k])
                for b in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(b)
                    crc = [zlib.crc32(shard.ids(s, n).astype("<u4").tobytes()) for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist())]
                    starts = pa.array(docs.column(1).to_numpy() + bases[k])
                    ids = pa.array([None if i == LAST_ID else i for i in docs.column(0).to_pylist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, starts, docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files in the shared folder and read their documents back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    return read_documents(spark, folder, write_token_files(docs, path, end_id, folder, id_col, text_col))
