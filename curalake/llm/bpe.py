"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

The automaton reads tokens; it accepts exactly the token sequences that BPE can produce. It starts
as one state with a loop for every base symbol. Each merge (a, b) -> c applies a gadget, in rank order:

* an arc on c leaves every state that has an arc on a, and enters a copy of the state that b enters;
* the state that a enters loses its arc on b.

So a state is known by the last token read, and a gadget is two entries: the state of c was copied
from that of b at this rank, and the state of a lost b at this rank. Whether a state still has an arc
is read off these entries; answers are kept in a transition table. As every prefix of a word has one
accepted tokenization, a word is encoded from left to right: from each state the longest arc that the
letters allow is taken, and a position from which the word can't be ended is marked dead and left for
good. The tokens that start at a position are found with a table of byte transitions. Decoding emits the
labels of the arcs.

Words are independent of each other, so documents are encoded in parallel with no shuffle, and each
Python worker keeps the words it has met in a memo of fixed size.

Defined results: null texts count as empty; empty texts have no tokens and decode to the empty text; very long texts
and words are encoded whole, in time that grows with their length; equal rows get equal results, one row each; an empty
table gives no rows. Columns other than id and text are not read, so their names may clash with any here.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curalake.llm.common import Memo, give_back

#: White space as Unicode has it; str.split() also splits at \x1c-\x1f, which are not white space.
_SPLITS_MORE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Scripts of which some version of Unicode has characters that others haven't. Letters before these, and general punctuation, are settled.
_RARE = re.compile("[\u0530-\u1fff\u2065\u2070-\U0010ffff]")


def byte_letters() -> list[str]:
    """For each byte the character that stands for it in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


class MergeAutomaton:
    """The automaton of a list of merges over base symbols given as integers."""

    def __init__(self, symbols: list[int], merges: list[tuple[int, int, int]]):
        """symbols: tokens that are base symbols; merges: (left, right, merged) in rank order, each merged one new."""
        self.copied: dict[int, tuple[int, int, int]] = {}  # token: rank of its gadget, its left, its right
        self.lost: dict[tuple[int, int], int] = {}  # (a, b): the rank at which the state of a lost the arc on b
        self.table: dict[int, dict[int, bool]] = {}
        known = set(symbols)
        for rank, (a, b, c) in enumerate(merges):
            if a not in known or b not in known or c in known:
                raise ValueError(f"merge {rank} uses a token that is not there yet, or makes one that is")
            if self.reached(a) and self.reached(b) and self._has(a, b):  # else BPE never comes to this merge, and the gadget does nothing
                self.lost[a, b] = rank
            self.copied[c] = (rank, a, b)
            known.add(c)

    def _has(self, a: int, b: int) -> bool:
        """Whether the state that a enters has an arc on b, by the entries so far.

        A step back in rank undoes the later of the two gadgets: the state of a token was its right part's, its arc was its left part's.
        """
        born_a, _, right = self.copied.get(a, (-1, 0, 0))
        born_b, left, _ = self.copied.get(b, (-1, 0, 0))
        before_a = before_b = 1 << 62  # when a and b became part of what follows
        while True:
            rank = self.lost.get((a, b))
            if rank is not None and rank < before_a and rank <= before_b:
                return False
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b or (born_a == born_b and born_b < 0):
                before_a, a = born_a, right
                born_a, _, right = self.copied.get(a, (-1, 0, 0))
            else:
                before_b, b = born_b, left
                born_b, left, _ = self.copied.get(b, (-1, 0, 0))

    def arc(self, a: int, b: int) -> bool:
        """Whether token b can follow token a."""
        row = self.table.get(a)
        if row is None:
            if len(self.table) > 50_000:
                self.table.clear()
            row = self.table[a] = {}
        has = row.get(b)
        if has is None:
            has = row[b] = self._has(a, b)
        return has

    def reached(self, token: int) -> bool:
        """Whether BPE can come to the token at all: its gadget found a path to bypass."""
        rank, a, b = self.copied.get(token, (-1, 0, 0))
        return rank < 0 or self.lost.get((a, b)) == rank


class WordBPE:
    """A tokenizer file with lower-casing, word ends and byte-level letters."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.library = Tokenizer.from_file(path)  # for normalising and splitting what Unicode versions differ on
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = {a + b for a, b in pairs}
        symbols = [i for t, i in vocab.items() if t not in merged and t not in self.special]
        self.automaton = MergeAutomaton(symbols, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = 1  # symbols of the longest token
        self.start: dict = {}  # byte transitions: symbol to the next node; a node's token, if it has one, is under 0
        for text, i in vocab.items():
            if text not in self.special and self.automaton.reached(i):
                self._add(text, i)
        self.pieces, self.words = Memo(self._piece, 50_000), Memo(self._word, 125_000)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _add(self, text: str, token: int) -> None:
        """The word end belongs to the symbol before it."""
        symbols = list(text)
        if self.end and text.endswith(self.end):
            symbols = list(text[: -len(self.end)])
            symbols[-1:] = [symbols[-1] + self.end] if symbols else [self.end]
        self.longest = max(self.longest, len(symbols))
        node = self.start
        for s in symbols:
            node = node.setdefault(s, {})
        node[0] = token

    def _piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one pre-split piece."""
        symbols = list(map(self.letters.__getitem__, text.encode()))
        symbols[-1] += self.end
        n, start, arc = len(symbols), self.start, self.automaton.arc
        path: list[int] = []
        ends: list[int] = [0]
        open_arcs: list[list[tuple[int, int]]] = []  # for each state on the path the arcs not tried yet, the longest last
        dead: set[int] = set()
        i = 0
        while i < n:
            if len(open_arcs) == len(path):
                arcs, node, j = [], start, i
                for s in symbols[i : i + self.longest]:
                    node = node.get(s)
                    if node is None:
                        break
                    j += 1
                    if 0 in node:
                        arcs.append((j, node[0]))
                open_arcs.append(arcs)
            arcs = open_arcs[-1]
            while arcs:
                j, t = arcs.pop()
                if j not in dead and (not path or arc(path[-1], t)):
                    path.append(t)
                    ends.append(j)
                    i = j
                    break
            else:  # no accepted sequence goes through here
                if not path:
                    raise ValueError(f"no tokens for {text!r}")
                dead.add(i)
                open_arcs.pop()
                path.pop()
                ends.pop()
                i = ends[-1]
        return tuple(path)

    def _word(self, word: str) -> tuple[int, ...]:
        if _RARE.search(word):
            found = [word[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        else:
            found = self.pattern.findall(word)
        if len(found) == 1:
            return self.pieces[found[0]]
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        if self.marks is not None and self.marks.search(text):
            out: list[int] = []
            at = 0
            for m in self.marks.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(self.special[m.group()])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        if _RARE.search(text):
            return list(chain.from_iterable(map(self.words.__getitem__, self.library.normalizer.normalize_str(text).split(" ")))) if text.strip(" ") else []
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        words = _WORDS.findall(text) if _SPLITS_MORE.search(text) else text.split()
        return list(chain.from_iterable(map(self.words.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """Compiled once in each Python worker."""
    return WordBPE(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with a column of token ids; the new column replaces one of the same name."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return texts.map(lambda x: t.encode(x or ""))

    return docs.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return ids.map(lambda x: None if x is None else t.decode(x))

    return docs.withColumn(out_col, text(F.col(ids_col)))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Encodes and decodes in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = WordBPE(path)  # compiled for the task, and gone with it
        decimal = {i: str(i) for i in t.labels}.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = t.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del t, decimal
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
