"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Terms (words and beginnings of words) get log-odds of toxic against clean from the distinct texts of labelled
   documents; those that few texts, or few contexts, support are left out: both counts must give the odds.
   So neither copies of one document nor near copies count as many, and copies don't outweigh other uses.
3. Tokens that look disguised (digits or signs between letters, a letter three times, spelled-out letters)
   become a lattice: each sign may stand for its letters, a separator or a repeat may stand for nothing. Viterbi
   decoding under the character model, mixed with one of the terms, restores the likeliest word.
4. The score of a document is the logistic of its prior log-odds and those of the distinct terms in its
   words, restored ones included.

Labels are learned from a sample of at most SAMPLE labelled rows of each class, in the order of a hash of the id.

Defined results: null and empty texts have the prior score; labels that are null or of other documents
are not used; without labels of both classes no document is toxic and the score is 0. Whether a label is
held out depends on the id alone; of an id that is labelled twice the larger label counts; equal rows get equal scores;
an empty table gives no rows. Very long texts and tokens are scored whole, in time that grows with their length. Columns
other than id and text are not read, so their names may clash with any here; `drop_toxic` returns all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import Memo, give_back, id_crc32, saved, text_bytes

#: Most labelled rows of each class that are learned from.
SAMPLE = 6000
#: What a term must have: distinct toxic texts, and log-odds of toxic against clean.
LEAST_TEXTS, LEAST_ODDS = 3, 3.0
#: The prior log-odds stay below this (a share of 0.27), since labels are often drawn more evenly than documents are.
MOST_PRIOR = -1.0
PREFIXES = range(4, 8)
THRESHOLD = 0.7

#: What a sign can stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: What may stand between the letters of a word.
GAPS = " ._*-~'"

_SIGN = re.escape("".join(SIGNS))
_GAP = re.escape(GAPS)
#: Letters and signs spelled out in one token.
_SPREAD = re.compile(rf"(?<![^\W\d_])(?:[^\W\d_]|[{_SIGN}])(?:[{_GAP}](?:[^\W\d_]|[{_SIGN}])){{3,}}(?![^\W\d_])")
#: Letters and signs without gaps, and a sign between two letters.
_CHUNK = re.compile(rf"(?:[^\W\d_]|[{_SIGN}]){{2,}}")
_INSIDE = re.compile(rf"[^\W\d_][{_SIGN}]+[^\W\d_]")
_LETTER = re.compile(r"[^\W\d_]")
_THREE = re.compile(r"([^\W\d_])\1\1")
#: Letters that stand alone, four or more in a row.
_SPELLED = re.compile(rf"(?<!\S)(?:[^\W\d_]|[{_SIGN}])(?: (?:[^\W\d_]|[{_SIGN}])){{3,}}(?!\S)")
#: Bytes to 64 symbols: 0 is the end of a word, 1-26 are letters, 32-63 are the bytes of other characters.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[ord("a") : ord("z") + 1] = _SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = 32 + np.arange(128) % 32
#: What isn't part of a word in ASCII becomes a space.
_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Bytes of text that trigrams are counted in at once.
PIECE = 1 << 20


def disguised(token: str) -> Iterator[str]:
    """The parts of a token that look disguised, in time that grows with its length."""
    for m in _SPREAD.finditer(token):
        yield m.group()
    for m in _CHUNK.finditer(token):
        chunk = m.group()
        letter = _LETTER.search(chunk)
        if letter is None:
            continue
        first = letter.start()
        if first:  # the last sign before the letters
            if len(chunk) - first > 1:
                yield chunk[first - 1 :]
        elif _INSIDE.search(chunk) or _THREE.search(chunk):
            yield chunk


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts; at most 64 ** 3 rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for batch in batches:
            held: list[bytes] = []
            size = 0
            for text in batch.column(0):
                text = text.as_py()
                held += (b"  ", text)
                size += len(text)
                if size >= PIECE:
                    _add_trigrams(b"".join([*held, b"  "]), total)
                    held, size = [], 0
            _add_trigrams(b"".join([*held, b"  "]), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])
        give_back()

    rows = docs.select(text_bytes(text_col).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((64, 64, 64))
    for r in rows:
        out[r.gram >> 12, r.gram >> 6 & 63, r.gram & 63] = r.n
    return out


def _add_trigrams(text: bytes, total: np.ndarray) -> None:
    codes = np.frombuffer(text, np.uint8)
    for at in range(0, len(codes) - 2, PIECE):
        s = _SYMBOL[codes[at : at + PIECE + 2]]
        total += np.bincount(s[:-2] << 12 | s[1:-1] << 6 | s[2:], minlength=1 << 18)


def _model(counts: np.ndarray) -> np.ndarray:
    """P(c | a, b), backed off to P(c | b) and P(c)."""
    one = counts.sum((0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by the sample and 64 ** 3."""

    terms: dict[str, float]
    prior: float
    letters: np.ndarray
    log_letters: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        counts = np.zeros((64, 64, 64))
        for term, weight in self.terms.items():
            s = _SYMBOL[np.frombuffer(b" " + term.encode() + b" ", np.uint8)]
            np.add.at(counts, (s[:-2], s[1:-1], s[2:]), max(weight, 0))
        self.log_letters = np.log(0.7 * _model(self.letters) + 0.3 * _model(counts)).astype(np.float32)

    def term(self, word: str) -> str | None:
        """The term with the largest log-odds among the word and its beginnings."""
        own = [t for t in _terms(word) if t in self.terms]
        return max(own, key=self.terms.__getitem__) if own else None

    def restore(self, token: str) -> str:
        """The likeliest word behind a disguised token: the best path through the lattice of its signs, by Viterbi decoding."""
        lm = self.log_letters
        # State (a, b), the last two symbols: the score of the best path there and its last letter, linked to those before.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for k, c in enumerate(token):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options, skip = self._choices(c, c == token[k - 1] if k else False, token[k - 2 : k] == c * 2 if k > 1 else False)
            for (a, b), (score, word) in best.items():
                if skip is not None and ((a, b) not in after or score + skip > after[a, b][0]):
                    after[a, b] = score + skip, word
                for x, cost, symbols in options:
                    p, q, s = a, b, score + cost
                    for y in symbols:
                        s += lm.item(p, q, y)
                        p, q = q, y
                    if (p, q) not in after or s > after[p, q][0]:
                        after[p, q] = s, (word, x)
            best = after or best
        _, word = max(((score + lm.item(a, b, 0), word) for (a, b), (score, word) in best.items()), key=lambda x: x[0])
        letters = []
        while word is not None:
            word, x = word
            letters.append(x)
        return "".join(reversed(letters))

    @staticmethod
    @lru_cache(maxsize=4096)
    def _choices(c: str, repeats: bool, third: bool) -> tuple[tuple[tuple[str, float, tuple[int, ...]], ...], float | None]:
        """What a sign may stand for, with costs, and the cost of leaving it out (None: it can't be)."""
        options = [(c, -0.1)] if c.isalpha() else [(x, -0.7) for x in SIGNS.get(c, "")]
        skip = -0.3 if c in GAPS else (-1.0 if third else -2.5) if repeats else -6.0 if not c.isalpha() else None
        return tuple((x, cost, tuple(_SYMBOL[list(x.encode())].tolist())) for x, cost in options), skip


class Scorer:
    """Scores texts in one Python worker; tokens between white space are looked up in a memo of fixed size."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.tokens = Memo(self._token, 150_000)

    def _token(self, token: str) -> tuple[str, ...]:
        """The terms of a token, those behind a disguise included."""
        words = token.encode().translate(_WORDS).decode().split()
        found = {self.model.term(w) for w in words}
        if not token.isalpha() or _THREE.search(token):
            found.update(self.model.term(self.model.restore(x)) for x in disguised(token))
        found.discard(None)
        return tuple(found)

    def hits(self, text: str) -> set[str]:
        text = text.lower()
        out = set(chain.from_iterable(set(map(self.tokens.__getitem__, text.split()))))
        for m in _SPELLED.finditer(text):
            term = self.model.term(self.model.restore(m.group()))
            if term:
                out.add(term)
        return out

    def score(self, text: str) -> float:
        x = self.model.prior + sum(map(self.model.terms.__getitem__, sorted(self.hits(text))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _sample(labels: DataFrame, id_col: str, label_col: str, learn) -> DataFrame:
    """(id, y): at most SAMPLE rows of each class to learn from."""
    rows = labels.where(learn).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.md5(F.col("id").cast("string")))
    picked = [rows.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE) for y in (0, 1)]
    return picked[0].unionByName(picked[1]).select("id", "y")


def _split(text: bytes) -> list[str]:
    return text.decode().lower().encode().translate(_WORDS).decode().split()


def _terms(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """The model; None without labelled documents of both classes."""
    sample = F.broadcast(_sample(labels, id_col, label_col, id_crc32(id_col) % 3 != 1))  # 2 * SAMPLE rows at most
    rows = saved(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).join(sample, "id").select("y", "text").distinct(), "sample")
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter[str], Counter[str]] = Counter(), Counter()

        def counts() -> pa.RecordBatch:
            own = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(own), *(pa.array([held[y][t] for t in own], pa.int64()) for y in (1, 0))], ["term", "toxic", "clean"])
            held[0].clear()
            held[1].clear()
            return out

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[y].update({t for w in set(_split(text.as_py())) for t in _terms(w)})
                if len(held[0]) + len(held[1]) > 400_000:
                    yield counts()
        if held[0] or held[1]:
            yield counts()
        give_back()

    # Less one standard deviation, so that few documents don't make a term.
    odds = F.log((F.col("toxic") - F.sqrt("toxic")) / totals[1]) - F.log((F.col("clean") + 1) / totals[0])
    enough = (F.col("toxic") >= LEAST_TEXTS) & (odds >= LEAST_ODDS)
    by_doc = rows.mapInArrow(terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = sorted(by_doc.where(enough).withColumn("odds", odds).collect(), key=lambda r: (-r.odds * r.toxic, r.term))  # terms of the sample
    known = {r.term for r in strong}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _split(text.as_py())
                for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                    out.update((y, t, f"{before} {after}") for t in _terms(w) if t in known)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.string()))], ["y", "term", "around"])

    # Near copies repeat the contexts of a term: it must be as strong when no class has more uses of it than contexts.
    around = rows.mapInArrow(contexts, "y int, term string, around string").distinct().groupBy("term").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean"))
    around = around.where(enough).collect()
    around = {r.term for r in around}
    kept = [r for r in strong if r.term in around]
    # A beginning goes if a longer term has nearly all of its documents: the rest of its words are others.
    longer: dict[str, int] = {}
    for r in kept:
        word = r.term.rstrip("-")
        for n in PREFIXES:
            if len(word) > n or (len(word) == n and word == r.term):
                longer[word[:n] + "-"] = max(longer.get(word[:n] + "-", 0), r.toxic)
    kept = [r for r in kept if not r.term.endswith("-") or longer.get(r.term, 0) < 0.8 * r.toxic]
    share = labels.where(id_crc32(id_col) % 3 != 1).where(F.col(label_col).isin(0, 1)).agg(F.avg(label_col)).first()[0]
    return ToxicityModel({r.term: r.odds for r in kept}, min(math.log(share / (1 - share)), MOST_PRIOR), letter_counts(docs, text_col))


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            s = [scorer.score(x.as_py().decode()) if scorer else 0.0 for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        del scorer
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_crc32(id_col) % 3 == 1).alias("held_out"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            keep = [not scorer or scorer.score(x.as_py() or "") < THRESHOLD for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)
