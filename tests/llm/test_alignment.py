"""Alignment of two tokenizers against plain Python over whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from curalake.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {i: len(t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    found, count = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        size_b = [1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
        joined = b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b)
        if joined != (" " + text).encode():
            found.append(None)
            continue
        ends = []
        for sizes in ([letters[i] for i in ids_a], size_b):
            at, own = 0, []
            for n in sizes:
                own.append((at, at + n))
                at += n
            ends.append(own)
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, links = [], []
        last = {cut: k for k, cut in enumerate(cuts)}
        own = [([], []) for _ in cuts]
        for side, ids in enumerate((ids_a, ids_b)):
            k = 0
            for i, (_, e) in zip(ids, ends[side]):
                own[k][side].append(i)
                k = last.get(e, k - 1) + 1
        groups = ["|".join(",".join(map(str, ids)) for ids in pair) for pair in own]
        j = 0
        for i, (s, e) in zip(ids_a, ends[0]):
            while ends[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ids_b) and ends[1][k][0] < e:
                links.append((i, ids_b[k]))
                k += 1
        count.update(links)
        found.append((len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for one in found:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [
    "a  b   c", " lead", "trail ", "  ", "\n", "a\nb \n c", "tab\t x", "don't we'll I'm", "日本語 テキスト です", "x ▁y", "▁", " nb sp  x", "a​ b", "é ́x", "😀 😀😀 a",
    "<|endoftext|> and </s> <s>", "=" * 500, "ab" * 4000, "1 22 333 4444", "\x00 \x01a b", "a᠎ b  c", "मुझे नहीं", "x" * 3 + " " + "-" * 70, "İstanbul ǅ ﬁ", "﻿bom ﻿ x",
]


@pytest.mark.parametrize("size", [1 << 26, 300])
def test_query(spark, docs, none, rows, monkeypatch, size):
    """Nulls, odd white space, marks, long words, repeated rows, clashing columns; slices of a few texts."""
    monkeypatch.setattr(alignment, "SLICE", size)
    odd = [(100 + k, t) for k, t in enumerate(ODD)]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in docs.columns if c not in ("doc_id", "text")})
    df = docs.unionByName(extra).withColumns({"word": F.lit(3), "slice": F.lit("x"), "a": F.lit(1.5)})
    every = [(i, t) for i, t, _ in rows] + odd
    got = sorted(map(tuple, alignment.align(df, A, B).collect()), key=str)
    assert got == sorted(((i, *r) for (i, _), r in zip(every, brute([t for _, t in every]))), key=str)
    assert alignment.align(none, A, B).count() == 0


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted(map(tuple, alignment.align(df, A, B).collect()))
    assert got == sorted((i, *r) for (i, _), r in zip(every, brute([t for _, t in every])))


def test_blocks():
    """Words are joined in blocks that needn't end where documents do."""
    import numpy as np
    import pyarrow as pa

    words = [["a", "b", "a"], ["b"], ["a"] * 9, ["b", "a"]]
    sums = {"a": (1, 2, 3, 4, 5, 6), "b": (10, 20, 30, 40, 50, 60)}
    head = {"slice": [4, 4], "kind": [0, 0], "word": ["a", "b"], "groups": ["1|2", "3|4"], **{c: [sums[w][k] for w in "ab"] for k, c in enumerate(alignment._SUMS)}, "doc_id": [None] * 2, "text": [None] * 2}
    tail = {"slice": [4] * 4, "kind": [1] * 4, "word": [None] * 4, "groups": [None] * 4, **{c: [None] * 4 for c in alignment._SUMS}, "doc_id": [1, 2, 3, 4], "text": [" ".join(w) for w in words]}
    types = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("word", pa.string()), ("groups", pa.string()), *((c, pa.int64()) for c in alignment._SUMS), ("doc_id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pydict(x, types) for x in (head, tail)]
    before = alignment.WORDS, alignment.LETTERS
    try:
        for block in (1, 2, 4, 100):
            alignment.WORDS, alignment.LETTERS = block, 3 * block
            got = [row for b in alignment._folded(iter(batches)) for row in b.to_pylist()]
            assert [row["doc_id"] for row in got] == [1, 2, 3, 4]
            for row, own in zip(got, words):
                assert [row[c] for c in alignment._SUMS] == list(np.sum([sums[w] for w in own], axis=0))
                assert row["groups_sha256"] == hashlib.sha256(";".join({"a": "1|2", "b": "3|4"}[w] for w in own).encode()).hexdigest()
    finally:
        alignment.WORDS, alignment.LETTERS = before


def test_odd_spaces_in_arrow():
    """Arrow finds the same odd spaces as Python's pattern, beside any character."""
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    beside = [chr(i) for i in [*range(1, 0x3100), 0xFEFF, 0x1F600]]
    texts = [f"a{c} b" for c in beside] + [f"a {c}b" for c in beside] + ["", " ", "a ", " a", "a b", "a  b", "a \n", "\n a"]
    assert pc.match_substring_regex(pa.array(texts), alignment._ODD).to_pylist() == [bool(re.search(alignment._ODD, t)) for t in texts]


@pytest.mark.parametrize("letters", [1, 30, 1 << 24])
def test_words_of_a_slice_are_counted_once(monkeypatch, letters):
    """However the texts of a slice come in batches and blocks, each of its words is one row; words are those of the pattern."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "LETTERS", letters)
    texts = [*ODD, "a b a", "b"] * 2
    slices = [k // 20 for k in range(len(texts))]
    batches = [pa.RecordBatch.from_pydict({"slice": pa.array(slices[k : k + 7], pa.int32()), "text": texts[k : k + 7]}) for k in range(0, len(texts), 7)]
    got = [(r["slice"], r["word"], r["n"]) for b in alignment._counted(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted((s, w, n) for (s, w), n in Counter((s, w) for s, t in zip(slices, texts) for w in alignment._SPLIT.split(t)).items())


def test_partial_counts_are_not_shuffled(spark, monkeypatch):
    """The table of words has no aggregation behind its shuffle, and a slice is one task."""
    made = {}
    keep = alignment.saved
    monkeypatch.setattr(alignment, "SLICE", 100)
    monkeypatch.setattr(alignment, "saved", lambda df, tag, **o: made.setdefault(tag, df) and keep(df, tag, **o))
    df = spark.createDataFrame([(k, f"one two{k} three " * 5 + "end") for k in range(40)], "doc_id long, text string")
    assert alignment.align(df, A, B).count() == 40
    plan = made["words"]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert made["words"].select(F.spark_partition_id().alias("p"), "slice").distinct().groupBy("p").count().where("count > 1").isEmpty()
