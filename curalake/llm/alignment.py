"""Groups and links between the tokens of two tokenizers, as Spark relations.

A is a byte-level BPE tokenizer, B a SentencePiece model; A reads a space and the text, B adds that space itself. Both cut
before a space between two characters that aren't white space: A's pattern starts a piece there, and B has no piece with a
white-space mark behind another character. So a text is a sequence of words between such cuts, its tokens are those of its
words, and each cut ends a token of A and of B. The alignment of a distinct word is computed once:

* its tokens are exploded with their positions, and windowed sums of their lengths give the byte at which each ends;
* a full equi-join of the tokens of A and B on word and end keeps every end once; where both sides are there, it is a cut;
* a running count of cuts is the group of an end;
* the same window carries the tokens to the ends that they cover: each end of either side is the end of exactly one link, that
  of the two tokens which cover it. So links take time in proportion to the tokens; a range join would compare all pairs of a group.

Links are counted by pair of ids, weighted by how often the word occurs, and joined back to the words' links. Documents are
dealt to slices of about SLICE bytes, where their words are counted; each slice then gets the results of its own distinct words,
and sums and joins them in the order of each text.

Defined results: null and empty texts, and texts with the character U+2581, which B turns into a space, have no tokens: zeros
and the empty string; a text without cuts is one word, however long; equal rows get equal results, one row each (rows with equal id
and text share a slice, and stream through its task); an empty table gives no rows. Columns other than id and text are not read,
so their names may clash with any here.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.llm.common import co_partitioned, discard, give_back, saved, setting
from curalake.llm.sentence_pieces import MARK

#: White space of any version of Unicode, controls and format characters: no cut is made next to them, though some would be safe.
_WHITE = r"\x00-\x20\x7f-\xa0\xad ᠎ -‏ -  -⁯　﻿" + MARK
_CUT = f" (?<=[^{_WHITE}] )(?=[^{_WHITE}])"
_SPLIT = re.compile(_CUT)
#: A space that is no cut, without the lookaround that Arrow lacks. A text without one, which is the usual text, is split at every space.
_ODD = f"(?:^|[{_WHITE}]) | (?:$|[{_WHITE}])"
#: Bytes of text of a slice, words that are joined at a time, and bytes of text that are split and looked up at a time.
SLICE, WORDS, LETTERS = 1 << 25, 1 << 17, 1 << 24

_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

#: A task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Tokenizers:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int32)
        for token, i in vocab.items():
            self.a_size[i] = len(token)  # a letter stands for a byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_size = np.array([1 if self.b.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int32)

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)], self.b.encode(words, num_threads=1)


def _encoded(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the ids of each side and the bytes of each id."""
    t = Tokenizers(a_path, b_path)
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            words = batch.column(0).to_pylist()
            size = 1 + pc.binary_length(batch.column(0).cast(pa.binary())).to_numpy()
            columns = []
            for ids, sizes in zip(t.encode(words), (t.a_size, t.b_size)):
                n = np.fromiter(map(len, ids), np.int32, len(ids))
                ends = np.r_[0, np.cumsum(n)].astype(np.int32)
                flat = np.fromiter((i for own in ids for i in own), np.int32, ends[-1])
                covered = np.r_[0, np.cumsum(sizes[flat])]
                if (covered[ends[1:]] - covered[ends[:-1]] != size).any():
                    raise ValueError("a tokenizer doesn't give the bytes of its text")
                columns += [pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, sizes[flat])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["word", "n", "a", "a_size", "b", "b_size"])
    del t
    give_back()


def encoded(counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """counts (word, n), each word once, as a table with a number w for each word and its ids: a, b with their sizes in bytes."""
    ids = counts.select("word", "n").mapInArrow(partial(_encoded, a_path, b_path), "word string, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>")
    return saved(ids.withColumn("w", F.monotonically_increasing_id()), "encoded")


def ends(words: DataFrame, side: str) -> DataFrame:
    """The tokens of one side: w, end (the byte behind the token) and its id under the name of the side."""
    tokens = words.select("w", F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size")).alias("tokens")).repartition("w")
    tokens = tokens.select("w", F.posexplode("tokens").alias("pos", "token"))
    upto = Window.partitionBy("w").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.select("w", F.sum("token.size").over(upto).alias("end"), F.col("token.id").alias(side))


def links(words: DataFrame) -> DataFrame:
    """One row for each link: w, end (where the shorter token ends), a and b (where they end there), a_id, b_id, and group, counted from the last."""
    joined = ends(words, "a").join(ends(words, "b"), ["w", "end"], "full")
    back = Window.partitionBy("w").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    return joined.select("w", "end", "a", "b", F.last("a", True).over(back).alias("a_id"), F.last("b", True).over(back).alias("b_id"), F.sum(cut).over(back).alias("group"))


def aligned(words: DataFrame) -> DataFrame:
    """One row for each word: w, word, n, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and its links."""

    def ids(side: str) -> Column:
        own = F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", F.col(side).cast("string").alias("id"))))
        return F.array_join(F.transform(F.sort_array(own), lambda x: x["id"]), ",")

    groups = links(words).groupBy("w", "group").agg(
        F.concat(ids("a"), F.lit("|"), ids("b")).alias("text"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("*").alias("n_links"), F.collect_list(F.struct("a_id", "b_id")).alias("links")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("group")).alias("group"), "text"))), lambda x: x["text"])
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_links")]
    rows = groups.groupBy("w").agg(F.array_join(ordered, ";").alias("groups"), F.count("*").alias("n_groups"), F.flatten(F.collect_list("links")).alias("links"), *sums)
    return rows.join(words.select("w", "word", "n").repartition("w"), "w")


def pair_counts(words: DataFrame) -> DataFrame:
    """For each pair of ids that is linked: how many links hold it (count), and whether no other pair of its b has more (best)."""
    pairs = saved(words.select("n", F.explode("links").alias("link")).groupBy("link.a_id", "link.b_id").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("b_id").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    out = pairs.join(F.broadcast(most), "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    out.pairs = pairs
    return out


def _split(docs: pa.Table) -> Iterator[tuple[pa.Table, pa.ListArray]]:
    """Documents with their words, LETTERS of text at a time; texts with an odd space are cut by the pattern, apart from the others."""
    upto = pc.binary_length(docs.column("text")).to_numpy().cumsum()
    low = 0
    while low < docs.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + LETTERS)))
        part = docs.slice(low, high - low)
        odd = pc.match_substring_regex(part.column("text"), _ODD)
        for own, cut in ((part.filter(pc.invert(odd)), lambda texts: pc.split_pattern(texts, " ")), (part.filter(odd), _by_pattern)):
            if own.num_rows:
                yield own, cut(own.column("text").combine_chunks())
        low = high


def _by_pattern(texts: pa.Array) -> pa.ListArray:
    return pa.concat_arrays([pa.array([_SPLIT.split(t.as_py())], pa.list_(pa.string())) for t in texts])


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[pa.RecordBatch]:
    """The parts of a batch whose rows are alike in the keys."""
    columns = [batch.column(k).to_numpy() for k in keys]
    edges = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0), True]) if batch.num_rows else []
    for low, high in zip(edges[:-1], edges[1:]):
        yield batch.slice(low, high - low)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of slices, one slice after the other, as the distinct words of each slice, with how often they occur."""
    at, size = None, 0
    held: list[pa.RecordBatch] = []  # texts of the slice, with size bytes: below LETTERS before the last batch
    counts: list[pa.Table] = []  # words of the slice, each once in a table

    def merged() -> pa.Table:
        words = pa.concat_tables(counts)
        return words.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]) if len(counts) > 1 else words

    def count() -> None:
        nonlocal size
        for _, lists in _split(pa.Table.from_batches(held)):
            counts.append(pa.Table.from_batches([pa.RecordBatch.from_struct_array(pc.value_counts(lists.flatten()))]).rename_columns(["word", "n"]))
        if len(counts) > 8:
            counts[:] = [merged()]
        held.clear()
        size = 0

    def slice_ends() -> Iterator[pa.RecordBatch]:
        if held:
            count()
        if counts:
            words = merged()
            counts.clear()
            words = pa.table({"slice": pa.repeat(pa.scalar(at, pa.int32()), words.num_rows), "word": words["word"], "n": words["n"]})
            yield from words.to_batches(max_chunksize=1 << 16)

    for whole in batches:
        for batch in _runs(whole, "slice"):
            if batch.column("slice")[0].as_py() != at:
                yield from slice_ends()
                at = batch.column("slice")[0].as_py()
            held.append(batch.select(["text"]))
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if size >= LETTERS:
                count()
    yield from slice_ends()
    give_back()


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("groups_sha256", pa.string())])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a slice behind the rows of its words, as the result of each document."""
    own: list[pa.RecordBatch] = []  # words of the slice
    at, table = None, None

    def results(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        flat = lists.flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        hashes = [hashlib.sha256() for _ in range(len(ids))]
        sums = np.zeros((len(_SUMS), len(ids)), np.int64)
        started = -1
        place = pc.index_in(flat, value_set=table["word"])  # builds a table of the slice's words each time, so blocks are large
        if place.null_count:
            raise ValueError("a word of a document isn't among the words of its slice")
        for low in range(0, len(flat), WORDS):
            high = min(low + WORDS, len(flat))
            part = place.slice(low, high - low)
            first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "left")
            cuts = np.clip(bounds[first : last + 1], low, high) - low
            where = part.to_numpy()
            for k, c in enumerate(_SUMS):
                sums[k, first:last] += np.add.reduceat(table[c][where], cuts[:-1], dtype=np.int64)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table["groups"].take(part)), b";")
            for doc, text in zip(range(first, last), texts.to_pylist()):
                hashes[doc].update(b";" + text if doc == started else text)
                started = doc
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, sums), pa.array([h.hexdigest() for h in hashes])], schema=_RESULT)

    def waiting() -> Iterator[pa.RecordBatch]:
        """Results of the documents that wait; the words of their slice are complete."""
        nonlocal own, table, size
        if table is None:
            table = {c: pa.chunked_array([b.column(c) for b in own]).combine_chunks() for c in ("word", "groups")}
            table["groups"] = table["groups"].cast(pa.binary())
            for c in _SUMS:  # a word has fewer tokens than an int32 can count
                table[c] = np.concatenate([b.column(c).to_numpy() for b in own]).astype(np.int64 if c == "count_sum" else np.int32)
            own = []
        for docs, lists in _split(pa.Table.from_batches(held)):
            yield results(docs.column("doc_id").combine_chunks(), lists)
        held.clear()
        size = 0

    held: list[pa.RecordBatch] = []  # documents of the slice, with size bytes of text: below LETTERS before the last batch
    size = 0
    for whole in batches:
        for batch in _runs(whole, "slice", "kind"):
            if batch.column("slice")[0].as_py() != at:
                if held:
                    yield from waiting()
                at, own, table = batch.column("slice")[0].as_py(), [], None
            if batch.column("kind")[0].as_py() == 0:
                own.append(batch.select(["word", "groups", *_SUMS]))
                continue
            held.append(batch.select(["doc_id", "text"]))
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if size >= LETTERS:
                yield from waiting()
    if held:
        yield from waiting()
    give_back()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when((text != "") & ~text.contains(MARK), text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = total // SLICE + 1
    dealt = rows.where("text is not null").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int"))
    # The texts of a slice meet, in a task of their own, before they are cut: its words are counted once, and no partial counts are shuffled.
    few = partial(setting, docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    with few():
        parts = saved(dealt.select("slice", "text").repartitionById(slices, "slice").mapInArrow(_counted, "slice int, word string, n long"), "words")
    ids = encoded(parts.groupBy("word").agg(F.sum("n").alias("n")), a_path, b_path)
    # Lists of a word are gathered in sorted order, one sort for both aggregations: a hash map of lists turns to sorting after 128 keys anyway, each time.
    with co_partitioned(docs.sparkSession), setting(docs.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        words = saved(aligned(ids), "aligned")
    discard(ids)
    pairs = pair_counts(words)
    scored = words.select("w", F.explode("links").alias("link")).select("w", "link.*").join(pairs, ["a_id", "b_id"])
    scored = scored.groupBy("w").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    results = saved(words.select("w", "word", "groups", *_SUMS[:4]).join(scored, "w").drop("w"), "results")
    discard(words, pairs.pairs)
    known = saved(parts.select("slice", "word").join(results, "word"), "known")
    discard(parts, results)
    head = known.select("slice", F.lit(0).alias("kind"), "word", "groups", *_SUMS, F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("word", "groups")] + [F.lit(None).cast("long").alias(c) for c in _SUMS]
    tail = dealt.select("slice", F.lit(1).alias("kind"), *nothing, "doc_id", "text")
    both = head.unionByName(tail).repartitionById(slices, "slice").sortWithinPartitions("slice", "kind")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups_sha256 string"
    with few():
        out = saved(both.mapInArrow(_folded, schema), "folded")
    discard(known)
    empty = rows.where("text is null").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in _SUMS), F.lit("").alias("groups_sha256"))
    return out.unionByName(empty)
